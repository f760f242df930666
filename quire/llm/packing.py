"""Best-fit packing of documents into sequences of a fixed length, by best-two-fit."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, n_tokens

#: Tokens in a sequence.
LENGTH = 2048
#: Pieces (documents, or parts of long ones) that are packed together, on average; shards only bound a task's memory.
SHARD = 20_000

SCHEMA = "bin_id bigint, pos int, doc_id bigint, piece int, start bigint, n_tokens bigint"


def best_two_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indices of lengths, each from 1 to size.

    A bin is filled greedily with the longest document left that fits. Then its smallest document
    s is replaced by two unpacked ones whose sum is over s and at most s plus the gap, the largest
    such sum there is; among equal sums the pair with the longest document. Equal lengths are
    taken in the order of their indices.
    """
    left: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        left.setdefault(lengths[i], []).append(i)
    there = sorted(left)

    def take(n: int) -> int:
        i = left[n].pop()
        if not left[n]:
            del left[n]
            there.pop(bisect_right(there, n) - 1)
        return i

    bins = []
    while there:
        bin_, gap = [], size
        while there and gap >= there[0]:
            n = there[bisect_right(there, gap) - 1]
            bin_.append(take(n))
            gap -= n
        smallest = lengths[bin_[-1]]
        if gap and there and 2 * there[0] <= gap + smallest:
            room = gap + smallest
            a = np.array(there[: bisect_right(there, room - there[0])])
            many = np.array([len(left[n]) > 1 for n in a.tolist()])
            k = np.searchsorted(a, room - a, side="right") - 1
            k = np.minimum(k, np.arange(len(a)))  # the second is at most as long as the first
            k = np.where((k == np.arange(len(a))) & ~many, k - 1, k)
            total = np.where(k >= 0, a + a[k], 0)
            best = len(a) - 1 - int(np.argmax(total[::-1]))
            if total[best] > smallest:
                out = bin_.pop()
                bin_ += [take(int(a[best])), take(int(a[k[best]]))]
                if smallest not in left:
                    there.insert(bisect_right(there, smallest), smallest)
                left.setdefault(smallest, []).append(out)
        bins.append(bin_)
    return bins


def pack(docs: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """One row for each piece of a document in a packed sequence, as SCHEMA names its columns.

    Tokens are what white space separates. A document of more than length tokens is cut into whole
    sequences and a rest; piece counts its parts, start is the first token of a part. pos is the
    place in the bin. Pieces are spread over shards by a hash, each packed on its own: about one
    bin a shard is left less full for that.

    * A null or empty text has no tokens and no row.
    * Repeated rows are documents of their own; a null doc_id is kept as null.
    * Among equal lengths the order is that of doc_id (null first), piece.
    * An empty table gives an empty table. Other columns aren't read.
    """
    pieces = (
        docs.select(F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), n_tokens(F.col("text")).alias("n"))
        .filter("n > 0")
        .select("doc_id", "no_id", "n", F.posexplode(F.sequence(F.lit(0), ((F.col("n") - 1) / length).cast("int"))).alias("piece", "_p"))
        .select("doc_id", "no_id", "piece", (F.col("piece").cast("bigint") * length).alias("start"), F.least(F.lit(length), F.col("n") - F.col("piece").cast("bigint") * length).alias("n_tokens"))
    )
    pieces = cut(pieces)  # all that needs the texts
    shards = max(1, -(-pieces.count() // shard))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(shards)))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["no_id", "doc_id", "piece", "n_tokens"], ascending=[False, True, True, True], ignore_index=True)
        bins = best_two_fit(pdf.n_tokens.tolist(), length)
        order = np.fromiter((i for b in bins for i in b), dtype=np.int64, count=len(pdf))
        sizes = np.array([len(b) for b in bins], dtype=np.int64)
        out = pdf.iloc[order].reset_index(drop=True)
        out["bin_id"] = (int(key[0]) << 32) + np.repeat(np.arange(len(bins)), sizes)
        out["pos"] = np.arange(len(out)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out["doc_id"] = out["doc_id"].astype("Int64").mask(out["no_id"])
        return out[["bin_id", "pos", "doc_id", "piece", "start", "n_tokens"]]

    # rows are small and the work on them isn't: without a number of its own, a few tasks would get all shards
    return pieces.repartition(shards, "shard").groupBy("shard").applyInPandas(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
