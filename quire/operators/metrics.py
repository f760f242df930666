"""How well tables were found: overlap, matching, cell and topology scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructType

from quire.functions import geometry
from quire.operators.lines import PAGE, sliced


def normal(text: Column) -> Column:
    """A cell's text for comparing: blanks as one, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def overlaps(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(page, f, t, iou) for tables (page, id, box) of a page that share some area."""
    a = found.select(*PAGE, F.col("id").alias("f"), *[F.col(c).alias(f"f_{c}") for c in geometry.BOX])
    b = truth.select(*PAGE, F.col("id").alias("t"), *[F.col(c).alias(f"t_{c}") for c in geometry.BOX])
    both = a.join(b, PAGE)
    return both.select(*PAGE, "f", "t", geometry.iou(geometry.box("f_"), geometry.box("t_")).alias("iou")).filter("iou > 0")


def match(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """One-to-one pairs, the largest overlap first (then the smaller ids), of at least `least`."""
    types = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    cols = ["f", "t", "iou"]
    schema = ArrayType(StructType.fromDDL(", ".join(f"{c} {types[c]}" for c in cols)))
    arrow = to_arrow_type(schema)

    def greedy(page: list[dict]) -> list[dict]:
        f, t, keep = set(), set(), []
        for row in page:
            if row["f"] not in f and row["t"] not in t:
                f.add(row["f"])
                t.add(row["t"])
                keep.append({c: row[c] for c in cols})
        return keep

    udf = F.arrow_udf(lambda pages: sliced(greedy, arrow, pages), schema).asNondeterministic()
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("iou")).alias("_o"), *cols)))
    pages = pairs.filter(F.col("iou") >= least).groupBy(*PAGE).agg(ranked.alias("_p"))
    return pages.select(*PAGE, F.explode(udf("_p")).alias("_m")).select(*PAGE, "_m.*")


def scores(hit: Column, found: Column, truth: Column) -> list[Column]:
    """precision, recall and f1; all 1 where there is nothing on either side."""
    none = (found == 0) & (truth == 0)
    p = F.when(none, 1.0).when(found > 0, hit / found).otherwise(0.0)
    r = F.when(none, 1.0).when(truth > 0, hit / truth).otherwise(0.0)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def common(found: DataFrame, truth: DataFrame, key: list[str], sign: list[str]) -> DataFrame:
    """(key, hit, n_found, n_truth, precision, recall, f1): what two bags of rows have in common, by key."""
    a = found.groupBy(*key, *sign).agg(F.count("*").alias("a"))
    b = truth.groupBy(*key, *sign).agg(F.count("*").alias("b"))
    both = a.join(b, [*key, *sign], "full").na.fill(0, ["a", "b"])
    out = both.groupBy(*key).agg(F.sum(F.least("a", "b")).alias("hit"), F.sum("a").alias("n_found"), F.sum("b").alias("n_truth"))
    return out.select("*", *scores(F.col("hit"), F.col("n_found"), F.col("n_truth")))


def cell_scores(found: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """By the texts of cells, as bags."""
    text = lambda d: d.withColumn("_t", normal(F.col("text")))
    return common(text(found), text(truth), key, ["_t"])


def topology_scores(found: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """By the places and spans of cells."""
    return common(found, truth, key, ["row", "col", "row_span", "col_span"])


def averages(per: DataFrame) -> DataFrame:
    return per.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def cell_rows(tables: DataFrame) -> DataFrame:
    """Nested tables (table_id, rows array<array<string>>) as (table_id, row, col, text)."""
    rows = tables.select("table_id", F.posexplode("rows").alias("row", "r"))
    return rows.select("table_id", "row", F.posexplode("r").alias("col", "text"))
