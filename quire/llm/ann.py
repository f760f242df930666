"""Nearest neighbours by stable projections in a kd-tree, with a chi-square stopping test."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import sharedfile
from quire.llm.common import new_folder, shared
from quire.llm.vectors import points

#: Neighbours of each row; the query's rows are those whose id is divisible by EVERY, against all rows.
K, EVERY = 10, 20
#: Dimensions of the projection.
PROJECTED = 8
#: A search stops when each neighbour not yet seen would, with this probability, have been seen.
CONFIDENCE = 0.95
#: Points that one file holds at most, and one leaf of the tree.
SHARD, LEAF = 16_384, 512
SEED = 7

SCHEMA = "vec_id bigint, rank int, neighbour_id bigint, distance double"


def chi2_cdf(x: float, m: int) -> float:
    """P(chi-square of m degrees <= x), by the series of the incomplete gamma function."""
    a, y = m / 2, x / 2
    if y <= 0:
        return 0.0
    if y > 400 + 4 * a:
        return 1.0
    term = total = 1 / a
    i = 0
    while term > total * 1e-15:
        i += 1
        term *= y / (a + i)
        total += term
    return min(1.0, total * exp(a * log(y) - y - lgamma(a)))


def chi2_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 4.0 * m + 400
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


def projection(dim: int, m: int, seed: int = SEED) -> np.ndarray:
    """Standard normal directions: a squared projected distance over the squared distance is chi-square of m degrees."""
    return np.random.RandomState(seed).standard_normal((dim, m)).astype(np.float32)


def stack(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float32, copy=False)


class Splits(dict):
    """The upper levels of the tree: node -> (dimension, value); node n has the children 2n, 2n + 1."""

    def descend(self, p: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The lowest node of each projected point; points on a split go by a bit of their hash."""
        node, level, open_ = np.ones(len(p), np.int64), 0, np.arange(len(p))
        while len(open_):
            for n in np.unique(node[open_]).tolist():
                at = open_[node[open_] == n]
                if (s := self.get(n)) is None:
                    open_ = open_[node[open_] != n]
                    continue
                x = p[at, s[0]]
                node[at] = 2 * n + np.where(x == s[1], (h[at] >> (level % 60)) & 1, x > s[1])
            level += 1
        return node


def leaves_of(p: np.ndarray, leaf: int) -> list[np.ndarray]:
    """The points by leaves of a kd-tree: halves by the widest dimension."""
    todo, out = [np.arange(len(p))], []
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            out.append(at)
            continue
        x = p[at]
        d = int(np.argmax(x.max(0) - x.min(0)))
        order = np.argsort(x[:, d], kind="stable")
        todo += [at[order[len(at) // 2 :]], at[order[: len(at) // 2]]]
    return out


class Index:
    """Where the shards lie: per shard, its box in the projection, and files of vectors, ids, leaf starts and leaf boxes."""

    def __init__(self, rows: list, dim: int, m: int, seed: int):
        rows = sorted(rows, key=lambda r: r.node)
        self.dim, self.m, self.seed = dim, m, seed
        self.lo = np.array([r.lo for r in rows], np.float32).reshape(len(rows), m)
        self.hi = np.array([r.hi for r in rows], np.float32).reshape(len(rows), m)
        self.files = [tuple(r.files) for r in rows]
        self.leaves = [r.leaves for r in rows]
        self.held: dict[int, list[np.ndarray]] = {}

    def shard(self, s: int) -> list[np.ndarray]:
        if s not in self.held:
            if len(self.held) >= 64:
                self.held.pop(next(iter(self.held)))
            self.held[s] = [sharedfile.get(f) for f in self.files[s]]
        return self.held[s]


def build(pts: DataFrame, dim: int, m: int = PROJECTED, shard: int = SHARD, leaf: int = LEAF, seed: int = SEED) -> Index:
    """The tree over all of pts (id, v), in the shared folder.

    The upper levels are split at medians of all points, one aggregation a level, until no node
    has more than shard points; a task then orders the points of one node by leaves.
    """
    a = projection(dim, m, seed)
    hashed = pts.withColumn("h", F.xxhash64("id", "v"))

    def placed(splits: Splits) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    p = stack(pdf["v"]) @ a
                    yield pd.DataFrame({"node": splits.descend(p, pdf["h"].to_numpy()), **{f"p{i}": p[:, i] for i in range(m)}})

        return hashed.mapInPandas(run, "node bigint, " + ", ".join(f"p{i} float" for i in range(m)))

    splits = Splits()
    while True:
        stats = placed(splits).groupBy("node").agg(F.count("*").alias("n"), *[F.struct((F.max(f"p{i}") - F.min(f"p{i}")).alias("w"), F.percentile_approx(f"p{i}", 0.5).alias("x")).alias(f"s{i}") for i in range(m)])
        large = stats.filter(F.col("n") > shard).collect()  # one row a node: 1/shard of the points
        if not large:
            break
        for r in large:
            i = max(range(m), key=lambda i: r[f"s{i}"].w)
            splits[r.node] = (i, np.float32(r[f"s{i}"].x))
    folder = new_folder(pts.sparkSession, "ann")

    def node_of(v: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(splits.descend(stack(v) @ a, h.to_numpy()) if len(v) else np.empty(0, np.int64))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id"], ignore_index=True)
        node, x, ids = int(pdf["node"].iloc[0]), stack(pdf["v"]), pdf["id"].to_numpy(np.int64)
        p = x @ a
        own = leaves_of(p, leaf)
        order = np.concatenate(own)
        lo, hi = np.array([p[i].min(0) for i in own]), np.array([p[i].max(0) for i in own])
        starts = np.concatenate([[0], np.cumsum([len(i) for i in own])]).astype(np.int64)
        files = [sharedfile.put(folder, f"{name}{node}", y) for name, y in (("x", x[order]), ("i", ids[order]), ("s", starts), ("l", lo), ("h", hi))]
        return pd.DataFrame({"node": [node], "leaves": [len(own)], "lo": [lo.min(0)], "hi": [hi.max(0)], "files": [files]})

    nodes = hashed.withColumn("node", F.pandas_udf(node_of, "bigint")("v", "h"))
    rows = nodes.groupBy("node").applyInPandas(write, "node bigint, leaves int, lo array<float>, hi array<float>, files array<string>").collect()
    return Index(rows, dim, m, seed)


def _gap(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distances of points (n, m) from boxes (b, m): (n, b)."""
    out = np.zeros((len(p), len(lo)), np.float64)
    for j in range(p.shape[1]):
        d = np.maximum(np.maximum(lo[None, :, j] - p[:, None, j], p[:, None, j] - hi[None, :, j]), 0)
        out += d.astype(np.float64) ** 2
    return out


def search(index: Index, shard: int, leaf: int, k: int, confidence: float, every: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the points of a leaf whose id is divisible by every: their ids, and (n, k) squared distances and ids of neighbours.

    Leaves are seen in the order of their projected distance from the nearest of the points. For
    a point q whose kth neighbour so far is at distance d, what lies in the projection beyond
    d * sqrt(quantile) would be nearer than d with a chance under 1 - confidence only: such a leaf
    isn't verified for q, and when there is no other leaf for any point, the search ends.
    """
    stop = chi2_quantile(confidence, index.m)
    x, ids, starts, *_ = index.shard(shard)
    own = np.arange(int(starts[leaf]), int(starts[leaf + 1]))
    me = own[ids[own] % every == 0]
    if not len(me):
        return ids[me], np.empty((0, k)), np.empty((0, k), np.int64)
    q = np.array(x[me])
    q64, n2 = q.astype(np.float64), (q**2).sum(1)
    p = q @ projection(index.dim, index.m, index.seed)
    n, near = len(q), 1e-5 * float((p**2).sum(1).max())  # what rounding may add to the distance of a copy
    dist, found = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
    heap = [(float(g), -1, s, -1) for s, g in enumerate(_gap(p, index.lo, index.hi).min(0))]
    heapq.heapify(heap)
    gaps: dict[int, np.ndarray] = {}
    while heap:
        bound, _, s, f = heapq.heappop(heap)
        if bound > stop * dist[:, -1].max() + near:
            break
        xs, is_, ss, lo, hi = index.shard(s)
        if f < 0:
            gaps[s] = _gap(p, lo, hi)
            for g, b in enumerate(gaps[s].min(0)):
                heapq.heappush(heap, (float(b), 0, s, g))
            continue
        rows = np.flatnonzero(gaps[s][:, f] <= stop * dist[:, -1] + near)
        if not len(rows):
            continue
        at = slice(int(ss[f]), int(ss[f + 1]))
        y, yi = np.array(xs[at]), np.array(is_[at])
        m2 = (y**2).sum(1)
        d = n2[rows, None] + m2[None, :] - 2 * (q[rows] @ y.T)
        if (s, f) == (shard, leaf):
            d[np.arange(len(rows)), me[rows] - own[0]] = np.inf
        slack = 1e-5 * (n2[rows] + m2.max())
        limit = dist[rows, -1]
        if len(y) > k and np.isinf(limit).any():  # what can't be among the k nearest isn't measured
            first = np.isinf(limit)
            limit = limit.copy()
            limit[first] = np.partition(d[first], k - 1, axis=1)[:, k - 1] + slack[first]
        i, j = np.nonzero((d <= (limit + slack)[:, None]) & np.isfinite(d))
        if not len(i):
            continue
        exact = np.concatenate([((q64[rows[i[c : c + 50_000]]] - y[j[c : c + 50_000]]) ** 2).sum(1) for c in range(0, len(i), 50_000)])
        hit = np.unique(i)
        old = rows[hit]
        who = np.concatenate([i, np.repeat(hit, k)])
        what = np.concatenate([exact, dist[old].ravel()])
        name = np.concatenate([yi[j], found[old].ravel()])
        order = np.lexsort((name, what, who))
        who, what, name = who[order], what[order], name[order]
        first = np.searchsorted(who, hit)
        take = first[:, None] + np.arange(k)
        dist[old], found[old] = what[take], name[take]
    return ids[me], dist, found


def neighbours(vecs: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", m: int = PROJECTED, confidence: float = CONFIDENCE, shard: int = SHARD, leaf: int = LEAF, seed: int = SEED, every: int = 1) -> DataFrame:
    """The k nearest other rows of each row by Euclidean distance, as SCHEMA names the columns.

    A point that belongs to the k nearest is missed with a chance under 1 - confidence. Every row
    is an answer, and a query if its id is divisible by every; distances are exact.

    * Rows with a null id, or a vector that is null, empty, or holds a null, NaN or infinite number are
      neither queries nor answers. Vectors of each length have neighbours of that length.
    * Rows alike in id and vector are one point; different vectors of one id are points of their
      own, each of which may have the other as its neighbour.
    * Equal distances are ranked by id. Copies are neighbours at distance 0.
    * With fewer than k other points, all are listed. An empty table gives an empty table.
    * Other columns aren't read.
    """
    out = [_neighbours(pts, dim, k, m, confidence, shard, leaf, seed, every) for pts, dim in points(vecs, vec_id, embedding)]
    return reduce(DataFrame.unionByName, out) if out else vecs.sparkSession.createDataFrame([], SCHEMA)


def _neighbours(pts: DataFrame, dim: int, k: int, m: int, confidence: float, shard: int, leaf: int, seed: int, every: int) -> DataFrame:
    spark = pts.sparkSession
    index = build(pts, dim, m, shard, leaf, seed)
    share = shared(spark, index)  # boxes and file names: some 300 bytes for each shard of points
    units = sum(index.leaves)
    todo = spark.createDataFrame(list(enumerate(index.leaves)), "shard int, leaves int").select("shard", F.explode(F.sequence(F.lit(0), F.col("leaves") - 1)).alias("leaf"))
    parts = min(units, max(int(spark.conf.get("spark.sql.shuffle.partitions")), units // 50))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = share()
        for pdf in batches:
            for s, f in zip(pdf["shard"], pdf["leaf"]):
                ids, dist, found = search(index, int(s), int(f), k, confidence, every)
                there = np.isfinite(dist)
                yield pd.DataFrame({"vec_id": np.repeat(ids, there.sum(1)), "rank": np.nonzero(there)[1] + 1, "neighbour_id": found[there], "distance": np.sqrt(dist[there])})

    return todo.repartition(parts, "shard", "leaf").mapInPandas(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    out = neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=EVERY)
    return out.withColumn("distance", F.round("distance", 6))


#: By all rows; the query is approximate, and agrees with it where no search ends early for want of near neighbours.
SQL = f"""
WITH e AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
), d AS (
  SELECT q.vec_id, e.vec_id AS neighbour_id, list_distance(q.v, e.v) AS distance FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % {EVERY} = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS rank FROM d
)
SELECT vec_id, rank::INTEGER AS rank, neighbour_id, round(distance, 6) AS distance FROM r WHERE rank <= {K}
"""
