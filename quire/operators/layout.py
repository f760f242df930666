"""Page layout: header and footer, gutters, columns, reading order. All steps are windows and joins a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.lines import PAGE, joined

HEADER, FOOTER = 0.08, 0.08
MIN_GUTTER, MIN_LINES, MAX_COLUMNS = 20.0, 0.1, 4


def zones(lines: DataFrame, height: float, header: float = HEADER, footer: float = FOOTER) -> DataFrame:
    """lines with zone: header, body or footer.

    By the middle of the line; a zone with more lines than 3 and a twentieth of the body's (rounded
    up) is body after all. Both limits count the body as it is before lines come back to it.
    """
    mid = (F.col("y0") + F.col("y1")) / 2
    zone = F.when(mid > height * (1 - header), "header").when(mid < height * footer, "footer").otherwise("body")
    w = Window.partitionBy(*PAGE)
    tagged = lines.withColumn("zone", zone)
    for z in ("header", "body", "footer"):
        tagged = tagged.withColumn(f"_{z}", F.sum((F.col("zone") == z).cast("int")).over(w))
    most = F.ceil(F.greatest(F.col("_body"), F.lit(1)) * 0.05) + 3
    real = F.when((F.col("zone") == "header") & (F.col("_header") > most), "body").when((F.col("zone") == "footer") & (F.col("_footer") > most), "body").otherwise(F.col("zone"))
    return tagged.withColumn("zone", real).drop("_header", "_body", "_footer")


def projection(body: DataFrame, width: float) -> DataFrame:
    """(page, bin, n): lines over each point of the page's width, for every bin of the page."""
    bins = int(-(-width // 1))
    first = F.greatest(F.floor("x0"), F.lit(0)).cast("int")
    last = F.least(F.ceil("x1"), F.lit(bins)).cast("int") - 1
    ext = F.collect_list(F.struct(first.alias("a"), (last + 1).alias("b")))
    pages = body.groupBy(*PAGE).agg(ext.alias("_ext"))
    runs = pages.select(*PAGE, F.explode(cover(F.lit(0), F.lit(bins))).alias("r"))
    return runs.select(*PAGE, F.explode(F.sequence(F.col("r.i0"), F.col("r.i1") - 1)).alias("bin"), F.col("r.n").cast("bigint").alias("n"))


def cover(low: Column, high: Column) -> Column:
    """An array of (i0, i1, n): the points from low to high in runs over which equally many of the column _ext (a, b)
    lie. Counts change only where one begins or ends, so only there they are taken."""
    ends = F.filter(F.concat(F.transform("_ext", lambda e: e["a"].cast("int")), F.transform("_ext", lambda e: e["b"].cast("int"))), lambda p: (p > low) & (p < high))
    cuts = F.concat(F.array(low), F.array_sort(F.array_distinct(ends)), F.array(high))
    over = lambda i: F.size(F.filter("_ext", lambda e: (e["a"] <= i) & (i < e["b"])))
    pairs = F.arrays_zip(F.slice(cuts, 1, F.size(cuts) - 1).alias("i0"), F.slice(cuts, 2, F.size(cuts) - 1).alias("i1"))
    return F.transform(pairs, lambda p: F.struct(p["i0"].alias("i0"), p["i1"].alias("i1"), over(p["i0"]).alias("n")))


def page_layout(zoned: DataFrame, width: float, min_gutter: float = MIN_GUTTER, min_lines: float = MIN_LINES, most: int = MAX_COLUMNS) -> DataFrame:
    """(page, lines, gutters, cols): the lines of each page as an array, and what parts its body.

    gutters: runs of nearly empty points inside the margins of 5 %, wide enough; nearly empty is
    what at most 2 % of the body's lines (rounded up) cover. cols: the bands between gutters that
    hold a tenth of the lines' middles or more, at most 4 from the left; the whole page where none
    is left, or without gutters. A page is gathered once; the rest is expressions on its arrays.
    """
    bins, margin = int(-(-width // 1)), int(width * 0.05)
    every = F.collect_list(F.struct(*[c for c in zoned.columns if c not in PAGE]))
    pages = zoned.groupBy(*PAGE).agg(every.alias("lines"))
    body = F.filter("lines", lambda x: x["zone"] == "body")
    pages = pages.withColumn("_ext", F.transform(body, lambda x: F.struct(F.greatest(F.floor(x["x0"]), F.lit(0)).alias("a"), F.least(F.ceil(x["x1"]), F.lit(bins)).alias("b"), ((x["x0"] + x["x1"]) / 2).alias("mid"))))
    pages = pages.withColumn("_low", F.ceil(F.size("_ext") * 0.02))
    low = F.filter(cover(F.lit(margin), F.lit(bins - margin)), lambda r: r["n"] <= F.col("_low"))
    run = lambda g0, g1: F.struct(g0.cast("double").alias("g0"), g1.cast("double").alias("g1"), ((g0 + g1) / 2).alias("center"))
    start = F.struct(F.array().cast("array<struct<g0:double,g1:double,center:double>>").alias("done"), F.lit(-1.0).alias("g0"), F.lit(-1.0).alias("g1"))
    closed = lambda a: F.when(a["g1"] - a["g0"] >= min_gutter, F.array_append(a["done"], run(a["g0"], a["g1"]))).otherwise(a["done"])
    step = lambda a, r: F.when(a["g1"] == r["i0"], F.struct(a["done"].alias("done"), a["g0"].alias("g0"), r["i1"].cast("double").alias("g1"))).otherwise(F.struct(closed(a).alias("done"), r["i0"].cast("double").alias("g0"), r["i1"].cast("double").alias("g1")))
    pages = pages.withColumn("gutters", F.when(F.size("_ext") > 0, F.aggregate(low, start, step, closed)).otherwise(start["done"]))
    ends = F.array_append(F.transform("gutters", lambda g: g["center"]), F.lit(float(width)))
    pages = pages.withColumn("_ends", ends)
    bands = F.transform("_ends", lambda c, i: F.struct(F.when(i == 0, 0.0).otherwise(F.col("_ends")[i - 1]).alias("c0"), c.alias("c1")))
    held = lambda c: F.size(F.filter("_ext", lambda e: (e["mid"] >= c["c0"]) & (e["mid"] < c["c1"])))
    kept = F.slice(F.filter(bands, lambda c: held(c) >= F.floor(F.greatest(F.size("_ext") * min_lines, F.lit(1.0)))), 1, most)
    whole = F.array(F.struct(F.lit(0.0).alias("c0"), F.lit(float(width)).alias("c1")))
    pages = pages.withColumn("cols", F.when(F.size("gutters") == 0, whole).otherwise(kept))
    return pages.withColumn("cols", F.when(F.size("cols") == 0, whole).otherwise(F.col("cols"))).drop("_ext", "_low", "_ends")


def gutters(laid: DataFrame) -> DataFrame:
    """(page, g0, g1, center) of page_layout()."""
    return laid.select(*PAGE, F.explode("gutters").alias("g")).select(*PAGE, "g.*")


def columns(laid: DataFrame) -> DataFrame:
    """(page, col, c0, c1) of page_layout()."""
    return laid.select(*PAGE, F.posexplode("cols").alias("col", "c")).select(*PAGE, "col", "c.*")


def placed(laid: DataFrame, width: float) -> DataFrame:
    """The lines of page_layout() with col and is_full.

    col: the band whose middle is nearest to the line's, the leftmost of equals. is_full: where
    there are several columns, a line over 70 % of the page wide, or over 20 points to both sides
    of a gutter. Both are 0 and false outside the body.
    """
    lines = laid.select(*PAGE, "gutters", "cols", F.explode("lines").alias("x")).select(*PAGE, "x.*", "gutters", "cols")
    mid = (F.col("x0") + F.col("x1")) / 2
    near = F.array_min(F.transform("cols", lambda c, i: F.struct(F.abs((c["c0"] + c["c1"]) / 2 - mid).alias("d"), i.alias("i"))))["i"]
    over = F.exists("gutters", lambda g: (F.col("x0") < g["center"]) & (F.col("x1") > g["center"]) & (g["g0"] - F.col("x0") > 20) & (F.col("x1") - g["g1"] > 20))
    full = (F.size("cols") > 1) & ((F.col("x1") - F.col("x0") > width * 0.7) | over)
    body = F.col("zone") == "body"
    return lines.withColumns({"col": F.when(body, near).otherwise(0), "is_full": body & full}).drop("gutters", "cols")


def analyze(lines: DataFrame, width: float, height: float) -> DataFrame:
    """lines with zone, col, is_full, region and ord, their place in reading order.

    Header first, then the body from the top: full-width lines part it into sections, in which
    columns follow each other from the left, each from the top down; the footer last.
    """
    every = placed(page_layout(zones(lines, height), width), width)
    outside = F.when(F.col("zone") == "header", -1).when(F.col("zone") == "footer", 1 << 30)
    down = Window.partitionBy(*PAGE).orderBy(F.desc("y1"), "line_idx")
    full = F.col("is_full").cast("int")
    every = every.withColumn("section", F.coalesce(outside, F.sum(full).over(down) * 2 - full))
    kind = F.when(F.col("zone") != "body", F.col("zone")).when(F.col("is_full"), "full_width").otherwise("body_column")
    order = Window.partitionBy(*PAGE).orderBy("section", F.when(F.col("is_full"), 0).otherwise(F.col("col")), F.desc("y1"), "line_idx")
    return every.withColumn("region", kind).withColumn("ord", F.row_number().over(order) - 1)


def layout_text(laid: DataFrame) -> DataFrame:
    """(page, text, columns): the lines in reading order, and how many columns hold some."""
    cols = F.count_distinct(F.when(F.col("region") == "body_column", F.col("col")))
    return laid.groupBy(*PAGE).agg(joined(F.col("text"), ["ord"], "\n").alias("text"), F.greatest(cols, F.lit(1)).cast("bigint").alias("columns"))
