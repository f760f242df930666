"""Differences between two versions of documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.lines import PAGE

SIMILAR = 0.3
OPS = "op_idx int, kind string, text_a string, text_b string, line_a int, line_b int"


def lcs_ops(a: list[str], b: list[str]) -> list[tuple[str, str | None, str | None, int | None, int | None]]:
    """Removed and added lines by a longest common subsequence; 0-based places.

    Read from the end, an addition is preferred where both are as good.
    """
    n, m = len(a), len(b)
    start = 0
    while start < min(n, m) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(n, m) - start and a[n - 1 - end] == b[m - 1 - end]:
        end += 1
    a, b = a[start : n - end], b[start : m - end]
    n, m = len(a), len(b)
    codes: dict[str, int] = {}
    ca = np.array([codes.setdefault(x, len(codes)) for x in a], np.int64)
    cb = np.array([codes.setdefault(x, len(codes)) for x in b], np.int64)
    # of the table of lengths, only one row is held, and of each place one bit: whether to go on to the left
    before, left = np.zeros(m + 1, np.int32), []
    for i in range(n):
        now = np.zeros(m + 1, np.int32)
        now[1:] = np.maximum.accumulate(np.maximum(before[1:], before[:-1] + (cb == ca[i])))
        left.append(np.packbits(now[:-1] >= before[1:]))
        before = now
    out = []
    i, j = n, m
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        elif j and (not i or left[i - 1][(j - 1) >> 3] >> (7 - ((j - 1) & 7)) & 1):
            j -= 1
            out.append(("added", None, b[j], None, start + j))
        else:
            i -= 1
            out.append(("removed", a[i], None, start + i, None))
    return out[::-1]


def merged_ops(ops: list[tuple]) -> list[tuple]:
    """Removed and added lines that follow each other and are alike become one changed line.

    Alike: the common start in characters is 0.3 or more of the shorter line's bytes.
    """
    out, i = [], 0
    while i < len(ops):
        if i + 1 < len(ops) and ops[i][0] == "removed" and ops[i + 1][0] == "added":
            x, y = ops[i][1], ops[i + 1][2]
            short = min(len(x.encode()), len(y.encode()))
            same = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            if short and same / short >= SIMILAR:
                out.append(("changed", x, y, ops[i][3], ops[i + 1][4]))
                i += 2
                continue
        out.append(ops[i])
        i += 1
    return out


def diff_lines(a: DataFrame, b: DataFrame, key: list[str] = PAGE) -> DataFrame:
    """(key, OPS): what changes from the lines of a (key, line_idx, text) to those of b, page by page.

    A page on one side only is all removed or all added. Only pages that differ reach the table of
    the subsequence: equal ones are sorted out by a hash of their lines.
    """
    page = lambda d, n: d.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("line_idx", "text"))), lambda x: x["text"]).alias(n))
    both = page(a, "la").join(page(b, "lb"), key, "full").filter(~F.col("la").eqNullSafe(F.col("lb")))

    def run(la: pd.Series, lb: pd.Series) -> pd.Series:
        rows = []
        for x, y in zip(la, lb):
            ops = merged_ops(lcs_ops([] if x is None else list(x), [] if y is None else list(y)))
            rows.append([dict(zip(("kind", "text_a", "text_b", "line_a", "line_b"), o)) for o in ops])
        return pd.Series(rows)

    udf = F.pandas_udf(run, "array<struct<kind string, text_a string, text_b string, line_a int, line_b int>>")
    return both.select(*key, F.posexplode(udf("la", "lb")).alias("op_idx", "o")).select(*key, "op_idx", "o.*")


def summary(ops: DataFrame, pages_a: DataFrame, pages_b: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row a document: pages changed (of those on both sides), added and removed, and lines by kind."""
    sides = pages_a.select(*PAGE, F.lit(1).alias("a")).join(pages_b.select(*PAGE, F.lit(1).alias("b")), PAGE, "full")
    changed = ops.select(*PAGE).distinct().withColumn("c", F.lit(1))
    pages = sides.join(changed, PAGE, "left").groupBy(doc).agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("c").isNotNull()).alias("pages_changed"), F.count_if(F.col("a").isNull()).alias("pages_added"), F.count_if(F.col("b").isNull()).alias("pages_removed")
    )
    lines = ops.groupBy(doc).agg(F.count_if(F.col("kind") == "added").alias("additions"), F.count_if(F.col("kind") == "removed").alias("removals"), F.count_if(F.col("kind") == "changed").alias("changes"))
    return pages.join(lines, doc, "left").na.fill(0, ["additions", "removals", "changes"])


def merge_changes(ops: DataFrame, key: list[str]) -> DataFrame:
    """merged_ops() as columns, for ops (key, op_idx, kind, text_a, text_b): a removed line is only
    ever followed by the added one it may merge with, so looking one ahead is exact."""
    w = Window.partitionBy(*key).orderBy("op_idx")
    y = F.lead("text_b").over(w)
    short = F.least(F.octet_length("text_a"), F.octet_length("y"))
    n = F.least(F.length("text_a"), F.length("y"))
    same = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), n), lambda i: F.substr("text_a", i, F.lit(1)) != F.substr("y", i, F.lit(1)))) - 1, n)
    alike = (F.col("kind") == "removed") & (F.col("k2") == "added") & F.when(short > 0, F.when(n > 0, same / short >= SIMILAR)).otherwise(False)
    out = ops.withColumns({"y": y, "k2": F.lead("kind").over(w)}).withColumn("m", F.coalesce(alike, F.lit(False)))
    out = out.withColumn("eaten", F.coalesce(F.lag("m").over(w), F.lit(False))).filter(~F.col("eaten"))
    return out.withColumns({"kind": F.when(F.col("m"), "changed").otherwise(F.col("kind")), "text_b": F.when(F.col("m"), F.col("y")).otherwise(F.col("text_b"))}).drop("y", "k2", "m", "eaten")


def changed_pixels(a: Column, b: Column, threshold: float | Column = 10.0) -> Column:
    """How many values of two arrays of the same length differ by more than threshold."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda v: v > threshold))


def similarity(changed: Column, total: Column) -> Column:
    """1 - changed / total; 1 for nothing."""
    return F.when(total > 0, 1.0 - changed / total).otherwise(1.0)
