"""Spans and rule lines with geometry, laid out from lineitem by a fixed rule, for Spark and for SQL.

A page is 612 x 792 points and has the lines of 40 orders; a document has 3 pages. Every order is
a line, each of its line numbers a span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.lines import PAGE, lines_of

WIDTH, HEIGHT = 612.0, 792.0


def spans(spark, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = items.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("f"))
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    text = F.when((n == 1) & (o % 9 == 0), F.concat(F.lit("- w"), F.col("p"))).when((n == 1) & (o % 9 == 1), F.concat(F.lit("3. w"), F.col("p"))).otherwise(F.concat(F.lit("w"), F.col("p")))
    # left half: line numbers 1 to 3; right half, behind a gutter: 4 to 7; some lines are full of text
    x = F.when(n <= 3, 40.0 + (n - 1) * 70.0).otherwise(330.0 + (n - 4) * 62.0) + F.col("q") / 10.0
    width = F.when(o % 13 == 0, 68.0).otherwise(F.length("text") * 6.0)
    size = F.when(o % 29 == 0, 18.0).when(o % 17 == 0, 14.0).when(o % 5 == 0, 9.5).otherwise(10.0)
    out = rows.withColumn("text", text).select(
        F.floor(o / 120).cast("bigint").alias("doc_id"),
        (F.floor((o % 120) / 40) + 1).cast("int").alias("page"),
        (o % 40).cast("int").alias("line_idx"),
        n.cast("int").alias("span_idx"),
        "text",
        x.alias("x"),
        (775.0 - (o % 40) * 19.0).cast("double").alias("y"),
        width.cast("double").alias("width"),
        size.alias("font_size"),
        F.when((F.col("f") == "R") & (o % 4 == 0), "Sans-Bold").otherwise("Sans").alias("font_name"),
    )
    return out


SPANS = """
spans AS (
  SELECT CAST(o // 120 AS BIGINT) AS doc_id, CAST((o % 120) // 40 + 1 AS INTEGER) AS page, CAST(o % 40 AS INTEGER) AS line_idx, n AS span_idx, text,
         CASE WHEN n <= 3 THEN 40.0::DOUBLE + (n - 1) * 70.0::DOUBLE ELSE 330.0::DOUBLE + (n - 4) * 62.0::DOUBLE END + q / 10.0::DOUBLE AS x,
         (775.0 - (o % 40) * 19.0)::DOUBLE AS y, CASE WHEN o % 13 = 0 THEN 68.0::DOUBLE ELSE (length(text) * 6.0)::DOUBLE END AS width,
         CASE WHEN o % 29 = 0 THEN 18.0::DOUBLE WHEN o % 17 = 0 THEN 14.0::DOUBLE WHEN o % 5 = 0 THEN 9.5::DOUBLE ELSE 10.0::DOUBLE END AS font_size,
         CASE WHEN f = 'R' AND o % 4 = 0 THEN 'Sans-Bold' ELSE 'Sans' END AS font_name
  FROM (
    SELECT l_orderkey AS o, l_linenumber AS n, max(l_quantity) AS q, max(l_returnflag) AS f,
           (CASE WHEN l_linenumber = 1 AND l_orderkey % 9 = 0 THEN '- w' WHEN l_linenumber = 1 AND l_orderkey % 9 = 1 THEN '3. w' ELSE 'w' END) || min(l_partkey) AS text
    FROM lineitem GROUP BY l_orderkey, l_linenumber
  )
)"""

TEXTS = """
gaps AS (
  SELECT *, lag(x + width) OVER w AS before, lag(font_size) OVER w AS fs FROM spans WINDOW w AS (PARTITION BY doc_id, page, line_idx ORDER BY span_idx)
), texts AS (
  SELECT doc_id, page, line_idx,
         string_agg((CASE WHEN x - before > (CASE WHEN fs > 0 THEN fs * 0.25 ELSE 2.0 END) THEN ' ' ELSE '' END) || text, '' ORDER BY span_idx) AS text
  FROM gaps GROUP BY doc_id, page, line_idx
)"""

BOXES = """
boxes AS (
  SELECT doc_id, page, line_idx, min(x) AS x0, min(y) AS y0, max(x + width) AS x1, max(y + font_size) AS y1 FROM spans GROUP BY doc_id, page, line_idx
)"""

LINES = f"{SPANS}, {TEXTS}, {BOXES}, lines AS (SELECT * FROM texts JOIN boxes USING (doc_id, page, line_idx))"


def lines(spark, sf_dir: str) -> DataFrame:
    return lines_of(spans(spark, sf_dir)).select(*PAGE, "line_idx", "text", "x0", "y0", "x1", "y1")


def rects(spark, sf_dir: str) -> DataFrame:
    """Rectangles of a page: one for each order, at 3 x 4 places; those of orders whose status is F fill a place of the grid."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    o, full = F.col("o_orderkey"), F.col("o_orderstatus") == "F"
    return orders.select(
        F.floor(o / 120).cast("bigint").alias("doc_id"), (F.floor((o % 120) / 40) + 1).cast("int").alias("page"),
        (40.0 + (o % 4) * 130.0).cast("double").alias("x"), (100.0 + (F.floor(o / 4) % 3) * 200.0).cast("double").alias("y"), F.when(full, 130.0).otherwise(20.0).alias("w"), F.when(full, 200.0).otherwise(12.0).alias("h"),
    ).distinct()


RECTS = """
rects AS (
  SELECT DISTINCT CAST(o_orderkey // 120 AS BIGINT) AS doc_id, CAST((o_orderkey % 120) // 40 + 1 AS INTEGER) AS page, (40.0 + (o_orderkey % 4) * 130.0)::DOUBLE AS x,
         (100.0 + ((o_orderkey // 4) % 3) * 200.0)::DOUBLE AS y, CASE WHEN o_orderstatus = 'F' THEN 130.0::DOUBLE ELSE 20.0::DOUBLE END AS w, CASE WHEN o_orderstatus = 'F' THEN 200.0::DOUBLE ELSE 12.0::DOUBLE END AS h
  FROM orders
)"""
