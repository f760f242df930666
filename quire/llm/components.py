"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each node that an edge names, with the smallest node it is linked to.

    Every round moves edges only; the least neighbour of a node is combined before the shuffle, so no
    neighbourhood is gathered in one row or one task. Rounds grow with the logarithm of the longest path. Edges from a node to itself and null ends are left out.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        # large-star: larger neighbours of u go to the smallest of u and its neighbours
        back = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = e.unionByName(back).groupBy("u").agg(F.min("v").alias("m"))
        large = back.join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # small-star: smaller neighbours of u, and u, go to the smallest of them
        low = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        e = cut(low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
