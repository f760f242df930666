"""What the operators on embeddings share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut


def points(vecs: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> list[tuple[DataFrame, int]]:
    """For each length of vector that there is, ((id, v) for each different usable row, the length).

    Usable is a row with an id and a vector that isn't empty and whose numbers are all there and
    finite. Vectors of different lengths aren't comparable; each length is a space of its own.
    """
    named = vecs.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<float>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    named = cut(named.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(fine).distinct())
    lengths = [r.d for r in named.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    return [(named.filter(F.size("v") == d) if len(lengths) > 1 else named, d) for d in lengths]
