"""From lines to headings, paragraphs and list items, by font size, weight and markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry, text as T
from quire.operators.lines import PAGE, joined, lines_of

HEADING_RATIO = 1.2
BLOCK = "doc_id bigint, page int, block_idx int, type string, text string, level int, indent_level int, x0 double, y0 double, x1 double, y1 double"


def bucket(size: Column) -> Column:
    """Font sizes by halves of a point, halves rounded away from zero."""
    return F.round(size * 2).cast("int")


def page_sizes(spans: DataFrame, ratio: float = HEADING_RATIO) -> DataFrame:
    """(page, body, heads): the size that most bytes of text have, and the buckets of headings, largest first.

    body is the smaller of equally frequent sizes, and 12 without text; headings begin at ratio x body.
    """
    w = F.when(F.trim("text") != "", F.octet_length("text")).otherwise(0)
    per = spans.repartition(*PAGE).withColumn("b", bucket(F.col("font_size"))).groupBy(*PAGE, "b").agg(F.sum(w).alias("n"), F.min("font_size").alias("lo"), F.max(F.when(F.trim("text") != "", F.col("font_size"))).alias("hi"))
    pages = per.groupBy(*PAGE).agg(F.collect_list(F.struct(F.col("n"), (-F.col("b")).alias("nb"), F.col("lo"), F.col("hi"))).alias("s"))
    best = F.array_max("s")
    pages = pages.withColumn("body", F.when(best["n"] > 0, best["lo"]).otherwise(12.0))
    heads = F.transform(F.array_sort(F.transform(F.filter("s", lambda x: F.coalesce(x["hi"] >= F.col("body") * ratio, F.lit(False))), lambda x: x["nb"])), lambda nb: -nb)
    return pages.select(*PAGE, "body", heads.alias("heads"))


def heading_levels(sizes: DataFrame) -> DataFrame:
    """(page, b, level) of page_sizes(): the largest size is level 1, none is over 6."""
    return sizes.select(*PAGE, F.posexplode("heads").alias("i", "b")).select(*PAGE, "b", F.least(F.col("i") + 1, F.lit(6)).alias("level"))


def left_margin(sized: DataFrame) -> Column:
    """Over lines (first_x, size, body) of a page: the least x of those whose size is within a point of the body's, 0 at least."""
    near = F.when(F.abs(F.col("size") - F.col("body")) < 1, F.col("first_x"))
    return F.greatest(F.min(near).over(Window.partitionBy(*PAGE)), F.when(F.min(near).over(Window.partitionBy(*PAGE)).isNotNull(), 0.0))


def is_bold(font: Column) -> Column:
    return F.coalesce(F.lower(font).rlike("bold|-bd|heavy"), F.lit(False))


def classified(spans: DataFrame, ratio: float = HEADING_RATIO) -> DataFrame:
    """One row a line: kind, level, indent, text and box, and body, the size of the page's text.

    Short bold lines at the body's size are headings one level below the lowest by size.
    """
    key = [*PAGE, "line_idx"]
    all_ = lines_of(spans, key).join(page_sizes(spans, ratio), PAGE)
    all_ = all_.withColumn("margin", left_margin(all_)).withColumn("lowest", F.least(F.size("heads"), F.lit(6)))
    nth = F.array_position("heads", bucket(F.col("size")))
    all_ = all_.withColumn("level", F.when(nth > 0, F.least(nth, F.lit(6))))
    bold = is_bold(F.col("font")) & (F.abs(F.col("size") - F.col("body")) < 1) & (F.octet_length("text") < 100) & (F.trim("text") != "")
    sized = F.col("level").isNotNull()
    item = T.is_list_item(F.col("text"))
    kind = F.when(sized | bold, "heading").when(item, "list_item").otherwise("paragraph")
    level = F.when(sized, F.col("level")).when(bold, F.least(F.coalesce("lowest", F.lit(0)) + 1, F.lit(6)))
    away = F.greatest(F.col("first_x") - F.coalesce("margin", F.lit(float("inf"))), F.lit(0.0))
    indent = F.when(kind == "list_item", F.round(away / 36).cast("int"))
    return all_.select(*key, kind.alias("kind"), level.cast("int").alias("level"), indent.alias("indent_level"), "text", *geometry.BOX, "body")


def blocks(lines: DataFrame) -> DataFrame:
    """Blocks of classified lines.

    Headings of one level that follow each other are one; so are paragraph lines while their
    middles are at most twice the body size apart. Every list item is one of its own.
    """
    w = Window.partitionBy(*PAGE).orderBy("line_idx")
    mid = (F.col("y0") + F.col("y1")) / 2
    same = (F.lag("kind").over(w) == F.col("kind")) & (
        ((F.col("kind") == "heading") & (F.lag("level").over(w) == F.col("level"))) | ((F.col("kind") == "paragraph") & (F.abs(F.lag(mid).over(w) - mid) <= F.col("body") * 2))
    )
    begins = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    island = lines.withColumn("new", begins).withColumn("block_idx", F.sum("new").over(w).cast("int") - 1)
    return island.groupBy(*PAGE, "block_idx").agg(
        F.first("kind").alias("type"), joined(F.col("text"), ["line_idx"], " ").alias("text"), F.first("level").alias("level"), F.first("indent_level").alias("indent_level"), *geometry.union_of()
    )


def extract(spans: DataFrame, ratio: float = HEADING_RATIO) -> DataFrame:
    """The blocks of each page; see classified() and blocks()."""
    return blocks(classified(spans, ratio))


def interleave(text_blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks and tables (page, table_id, box) in one order: the top edge from the top down; blocks
    before tables of the same height. Lines inside a table stay blocks too."""
    a = text_blocks.withColumns({"table_id": F.lit(None).cast("int"), "_o": F.lit(0)})
    b = tables.select(*PAGE, F.col("table_id").alias("block_idx"), F.lit("table").alias("type"), F.lit("").alias("text"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("indent_level"), *geometry.BOX, "table_id", F.lit(1).alias("_o"))
    order = Window.partitionBy(*PAGE).orderBy(F.desc("y1"), "_o", "block_idx")
    return a.unionByName(b).withColumn("block_idx", F.row_number().over(order) - 1).drop("_o")
