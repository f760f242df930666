"""Embedding near-dedup on a flat graph with robust pruning, built on overlapping cluster shards."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import sharedfile
from quire.llm.ann import stack
from quire.llm.common import cut, new_folder, shared
from quire.llm.components import components
from quire.llm.vectors import points

#: Vectors of this cosine similarity or more are near copies.
THRESHOLD = 0.95
#: Points that a shard holds at most, on average; clusters a level of the tree of clusters has.
SHARD, BRANCH, ROUNDS = 4096, 16, 3
#: Nearest points of a shard that an adjacency list is chosen from, its length, and how much nearer
#: to a chosen neighbour than to the point itself another must be to be left out.
POOL, DEGREE, ALPHA = 64, 24, 1.2
#: Width of the greedy search, and queries that search together.
BEAM, TOGETHER = 8, 64
#: Points whose true partners are counted over all rows, and the share of them to be found, as an average of the points.
AUDIT, RECALL = 512, 0.95
#: Points in a file of vectors.
BLOCK = 65_536


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero."""
    n = np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
    return (x / np.where(n > 0, n, 1)).astype(np.float32)


def close(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows a[i], b[i] are near copies, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    n = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    return (a * b).sum(1) >= threshold * np.where(n > 0, n, np.inf)


class Clusters:
    """The tree of clusters: for each inner node its children and their centroids."""

    def __init__(self):
        self.inner: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def two(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """(n, 2): of each unit vector the leaf it is nearest to, and the second nearest (or the same).

        At each level the two best of the children of the two nodes of a point are gone on with.
        """
        at = np.zeros((len(x), 2), np.int64)
        near = np.full((len(x), 2), -np.inf, np.float32)
        moved = True
        while moved:
            moved = False
            ids = np.full((len(x), 2, 2), -1, np.int64)
            sims = np.full((len(x), 2, 2), -np.inf, np.float32)
            for side in (0, 1):
                mine = np.ones(len(x), bool) if side == 0 else at[:, 1] != at[:, 0]
                for node in np.unique(at[mine, side]).tolist():
                    rows = np.flatnonzero(mine & (at[:, side] == node))
                    kids = self.inner.get(node)
                    if kids is None:
                        ids[rows, side, 0] = node
                        sims[rows, side, 0] = near[rows, side]
                        continue
                    moved = True
                    names, c = kids
                    if not c.shape[1]:  # children by hash
                        ids[rows, side, 0] = names[h[rows] % len(names)]
                        sims[rows, side, 0] = near[rows, side]
                        continue
                    s = x[rows] @ c.T
                    best = np.argsort(-s, axis=1, kind="stable")[:, :2]
                    for k in range(best.shape[1]):
                        ids[rows, side, k] = names[best[:, k]]
                        sims[rows, side, k] = np.take_along_axis(s, best[:, k : k + 1], 1)[:, 0]
            # the first stays below the first, so that nodes only ever shrink
            rest_i, rest_s = ids.reshape(len(x), 4)[:, 1:], sims.reshape(len(x), 4)[:, 1:]
            pick = np.argmax(np.where(rest_i >= 0, rest_s, -np.inf), 1)[:, None]
            second, far = np.take_along_axis(rest_i, pick, 1)[:, 0], np.take_along_axis(rest_s, pick, 1)[:, 0]
            first = ids[:, 0, 0]
            at = np.stack([first, np.where(second >= 0, second, first)], 1)
            near = np.stack([sims[:, 0, 0], far], 1)
        return at


def cluster(uniq: DataFrame, shard: int = SHARD, branch: int = BRANCH, rounds: int = ROUNDS) -> Clusters:
    """The tree of clusters over all of uniq (v, h): nodes of more than shard points are divided by
    rounds of spherical k-means, one aggregation over all points each. A node that centroids
    can't divide is divided by hash."""
    tree, names = Clusters(), 1
    spark = uniq.sparkSession

    def sizes() -> list:
        get = shared(spark, tree)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pd.DataFrame({"c": get().two(unit(stack(pdf["v"])), pdf["h"].to_numpy() & (1 << 62) - 1)[:, 0]})

        return uniq.mapInPandas(run, "c bigint").groupBy("c").agg(F.count("*").alias("n")).collect()  # one row a node

    def seeds(nodes: list[int]) -> dict[int, np.ndarray]:
        """For each node branch points, those of the smallest hashes."""
        get, want = shared(spark, tree), shared(spark, set(nodes))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[int, list] = {}
            for pdf in batches:
                if len(pdf):
                    c = get().two(unit(stack(pdf["v"])), pdf["h"].to_numpy() & (1 << 62) - 1)[:, 0]
                    for node, h, v in zip(c.tolist(), pdf["h"].tolist(), pdf["v"]):
                        if node in want():
                            best.setdefault(node, []).append((h, v))
                    best = {n: sorted(b, key=lambda t: t[0])[:branch] for n, b in best.items()}
            rows = [(n, h, v) for n, b in best.items() for h, v in b]
            yield pd.DataFrame(rows, columns=["c", "h", "v"])

        least = uniq.mapInPandas(run, "c bigint, h bigint, v array<float>").groupBy("c").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "v"))), 1, branch).alias("s"))
        return {r.c: unit(np.array([x.v for x in r.s], np.float32)) for r in least.collect()}

    before: dict[int, int] = {}
    while True:
        large = {r.c: r.n for r in sizes() if r.n > shard}
        if not large:
            return tree
        stuck = [n for n, size in large.items() if size > 0.9 * before.get(n, size + size)]
        todo = [n for n in large if n not in stuck]
        kids: dict[int, np.ndarray] = {}
        for n in stuck:
            parts = -(-large[n] // shard)
            tree.inner[n] = (np.arange(names, names + parts), np.empty((parts, 0), np.float32))
            names += parts
        found = seeds(todo) if todo else {}
        for n in todo:
            k = min(branch, max(2, -(-large[n] * 2 // shard)))
            kids[n] = np.arange(names, names + len(found[n][:k]))
            tree.inner[n] = (kids[n], found[n][:k])
            names += len(kids[n])
            before.update(dict.fromkeys(kids[n].tolist(), large[n]))
        for _ in range(rounds if todo else 0):
            get = shared(spark, tree)

            def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total: dict[int, np.ndarray] = {}
                for pdf in batches:
                    if len(pdf):
                        x = unit(stack(pdf["v"]))
                        c = get().two(x, pdf["h"].to_numpy() & (1 << 62) - 1)[:, 0]
                        for n in np.unique(c).tolist():
                            total[n] = total.get(n, 0) + x[c == n].sum(0, dtype=np.float64)
                yield pd.DataFrame({"c": list(total), "s": list(total.values())})

            added = uniq.mapInPandas(sums, "c bigint, s array<double>").select("c", F.posexplode("s").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x"))
            moved = {r.c: np.array([y.x for y in sorted(r.s)]) for r in added.groupBy("c").agg(F.collect_list(F.struct("i", "x")).alias("s")).collect()}
            for n in todo:
                c = tree.inner[n][1].copy()
                for j, kid in enumerate(kids[n].tolist()):
                    if kid in moved:
                        c[j] = unit(moved[kid][None, :])[0]
                tree.inner[n] = (kids[n], c)


def pruned(x: np.ndarray, pool: int = POOL, degree: int = DEGREE, alpha: float = ALPHA) -> tuple[list[np.ndarray], int]:
    """Adjacency lists of a shard of unit vectors, and its medoid.

    Each point's nearest neighbours, exact within the shard, and the medoid are pruned robustly: the
    nearest is taken, and what is alpha times nearer to it than to the point is left out, and so
    on. Edges hold both ways; a list that grows over twice the degree is pruned to its nearest.
    """
    n = len(x)
    medoid = int(np.argmax(x @ unit(x.sum(0, dtype=np.float64)[None, :].astype(np.float32))[0]))
    if n == 1:
        return [np.empty(0, np.int64)], medoid
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    k = min(pool, n - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
    near = np.concatenate([near, np.full((n, 1), medoid)], 1)
    rows = np.arange(n)
    away = 2 - 2 * np.take_along_axis(s, near, 1)  # squared distance
    away[near == rows[:, None]] = np.inf
    alive = np.isfinite(away)
    edges = np.zeros((n, n), bool)
    for _ in range(min(degree, k)):
        pick = np.argmax(alive, 1)
        some = alive[rows, pick]
        if not some.any():
            break
        r, p = rows[some], near[rows, pick][some]
        edges[r, p] = True
        other = 2 - 2 * s[p[:, None], near[r]]
        other[near[r] == p[:, None]] = -np.inf
        alive[r] &= alpha * alpha * np.where(other == -np.inf, other, np.maximum(other, 1e-6)) > away[r]
        alive[r, pick[some]] = False
    both = edges | edges.T
    most = 2 * degree
    out = []
    for i in range(n):
        j = np.flatnonzero(both[i])
        if len(j) > most and i != medoid:
            j = j[np.argsort(-s[i, j], kind="stable")[:most]]
        out.append(j)
    return out, medoid


class Graph:
    """The flat graph: vectors and adjacency lists of all points by number, in files of a range each."""

    def __init__(self, starts: list[int], files: list[tuple[str, str, str]], medoids: dict[int, int]):
        self.starts, self.files, self.medoids = np.array(starts, np.int64), files, medoids
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def file(self, b: int, which: int) -> np.ndarray:
        if (b, which) not in self.held:
            if len(self.held) >= 192:
                self.held.pop(next(iter(self.held)))
            self.held[b, which] = sharedfile.get(self.files[b][which])
        return self.held[b, which]

    def vectors(self, at: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.starts, at, side="right") - 1
        out = None
        for b in np.unique(block).tolist():
            mine = block == b
            x = self.file(b, 0)
            if out is None:
                out = np.empty((len(at), x.shape[1]), np.float32)
            out[mine] = x[at[mine] - self.starts[b]]
        return out

    def linked(self, at: np.ndarray) -> np.ndarray:
        """All neighbours of the points at, each once."""
        block, out = np.searchsorted(self.starts, at, side="right") - 1, []
        for b in np.unique(block).tolist():
            offsets, flat = self.file(b, 1), self.file(b, 2)
            i = at[block == b] - self.starts[b]
            lo, n = offsets[i], offsets[i + 1] - offsets[i]
            pos = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append(flat[pos])
        return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)


def build(spark, placed: DataFrame, starts: list[int], vectors: list[str], pool: int, degree: int, alpha: float, shard: int = SHARD) -> Graph:
    """The graph of placed (g, c1, c2, h, v), its numbers g in blocks that begin at starts.

    A cluster's shard holds the points nearest to it and those second nearest to it; where the latter
    are more than shard, they are spread over several shards, each with all of the former.
    """

    def lists(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g", ignore_index=True)
        g = pdf["g"].to_numpy(np.int64)
        near, medoid = pruned(unit(stack(pdf["v"])), pool, degree, alpha)
        return pd.DataFrame({"g": g, "near": [g[i] for i in near], "medoid_of": pd.Series([int(pdf["c"].iloc[0]) if i == medoid else None for i in range(len(g))], dtype="Int64")})

    seconds = placed.filter("c1 <> c2").select("g", "v", "h", F.col("c2").alias("c"))
    split = seconds.groupBy("c").agg(F.ceil(F.count("*") / shard).cast("int").alias("p")).filter("p > 1")
    firsts = placed.select("g", "v", F.col("c1").alias("c")).join(split, "c", "left").select("g", "v", "c", F.explode(F.sequence(F.lit(0), F.coalesce("p", F.lit(1)) - 1)).alias("part"))
    seconds = seconds.join(split, "c", "left").select("g", "v", "c", F.pmod("h", F.coalesce("p", F.lit(1))).cast("int").alias("part"))
    edges = cut(firsts.unionByName(seconds).groupBy("c", "part").applyInPandas(lists, "g bigint, near array<bigint>, medoid_of bigint"))
    medoids = {r.medoid_of: r.g for r in edges.filter("medoid_of IS NOT NULL").select("g", "medoid_of").collect()}  # one a shard
    folder = new_folder(spark, "graph")
    bounds = np.array(starts, np.int64)

    def block_of(g: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, g.to_numpy(), side="right") - 1)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g", ignore_index=True)
        b = int(pdf["b"].iloc[0])
        sizes = np.array([len(x) for x in pdf["near"]], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        return pd.DataFrame([(b, sharedfile.put(folder, f"o{b}", offsets), sharedfile.put(folder, f"n{b}", np.concatenate(pdf["near"].to_numpy()).astype(np.int64)))], columns=["b", "o", "n"])

    union = edges.groupBy("g").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    files = union.withColumn("b", F.pandas_udf(block_of, "bigint")("g")).groupBy("b").applyInPandas(write, "b bigint, o string, n string").collect()
    named = {r.b: (r.o, r.n) for r in files}
    return Graph(starts, [(x, *named[b]) for b, x in enumerate(vectors)], medoids)


def around(graph: Graph, at: np.ndarray, entries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, g): the near copies g of the points at[i], as a search for all of at together finds them.

    It begins at the entries and the points. What any of them has among the beam nearest seen, or
    within the range, is expanded, and what is seen so is measured against all of them; the range
    of a point with many near copies so grows until all it leads to is expanded.
    """
    q = graph.vectors(at)
    u = unit(q)
    seen = np.unique(np.concatenate([entries, at]))
    expanded = np.empty(0, np.int64)
    best_s, best_g = np.full((len(at), beam), -np.inf, np.float32), np.full((len(at), beam), -1, np.int64)
    new, who, what = seen, [], []
    while len(new):
        x = graph.vectors(new)
        s = u @ unit(x).T
        i, j = np.nonzero(s >= threshold - 1e-4)
        ok = (new[j] != at[i]) & close(q[i], x[j], threshold)
        who.append(i[ok])
        what.append(new[j[ok]])
        k = min(beam, len(new))
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        all_s = np.concatenate([best_s, np.take_along_axis(s, top, 1)], 1)
        all_g = np.concatenate([best_g, new[top]], 1)
        keep = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        best_s, best_g = np.take_along_axis(all_s, keep, 1), np.take_along_axis(all_g, keep, 1)
        front = np.setdiff1d(np.concatenate([best_g[best_g >= 0], what[-1]]), expanded)
        if not len(front):
            break
        expanded = np.union1d(expanded, front)
        new = np.setdiff1d(graph.linked(front), seen, assume_unique=True)
        seen = np.union1d(seen, new)
    return np.concatenate(who), np.concatenate(what)


class Forest:
    """Sets that are joined; add() says whether an edge joined two."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def add(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def joined(at: np.ndarray, i: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges that join the same points as the pairs (at[i], g): each g to one of the points of its set."""
    names, j = np.unique(g, return_inverse=True)
    label = np.arange(len(at))
    while True:
        far = np.full(len(names), len(at))
        np.minimum.at(far, j, label[i])
        now = label.copy()
        np.minimum.at(now, i, far[j])
        now = now[now]
        if (now == label).all():
            break
        label = now
    linked = np.unique(i)
    return np.concatenate([at[far], at[label[linked]]]), np.concatenate([names, at[linked]])


def edges_of(spark, placed: DataFrame, graph: Graph, threshold: float, beam: int, together: int) -> DataFrame:
    """(a, b): edges that join all near copies that searches from every point find."""
    get = shared(spark, graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, forest = get(), Forest()
        for pdf in batches:
            for k in range(0, len(pdf), together):
                part = pdf.iloc[k : k + together]
                at = part["g"].to_numpy(np.int64)
                entries = np.array([graph.medoids[c] for c in {*part["c1"].tolist(), *part["c2"].tolist()}], np.int64)
                i, g = around(graph, at, entries, threshold, beam)
                if len(i):
                    a, b = joined(at, i, g)
                    new = [(x, y) for x, y in zip(a.tolist(), b.tolist()) if x != y and forest.add(x, y)]
                    yield pd.DataFrame(new, columns=["a", "b"]).astype("int64")

    return placed.select("g", "c1", "c2").mapInPandas(run, "a bigint, b bigint")


def audit(placed: DataFrame, group: DataFrame, threshold: float = THRESHOLD, audited: int = AUDIT) -> tuple[int, float]:
    """(points that have near copies, the share of these that is in the point's group, on average), by brute
    force of the audited points of the smallest hashes against all points. Each point counts the same,
    however many copies it has."""
    spark = placed.sparkSession
    named = placed.join(group.withColumnRenamed("node", "g"), "g", "left").select("g", "h", "v", F.coalesce("component", "g").alias("c"))
    some = named.orderBy("h", "g").limit(audited).collect()
    if not some:
        return 0, 1.0
    q, qc, qg = np.array([r.v for r in some], np.float32), np.array([r.c for r in some]), np.array([r.g for r in some])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, hit = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for pdf in batches:
            if len(pdf):
                x = stack(pdf["v"])
                i, j = np.nonzero(unit(q) @ unit(x).T >= threshold - 1e-4)
                ok = (qg[i] != pdf["g"].to_numpy()[j]) & close(q[i], x[j], threshold)
                n += np.bincount(i[ok], minlength=len(q))
                hit += np.bincount(i[ok][qc[i[ok]] == pdf["c"].to_numpy()[j[ok]]], minlength=len(q))
        at = np.flatnonzero(n)
        yield pd.DataFrame({"i": at, "n": n[at], "hit": hit[at]})

    each = named.mapInPandas(run, "i bigint, n bigint, hit bigint").groupBy("i").agg((F.sum("hit") / F.sum("n")).alias("share"))
    r = each.agg(F.count("*"), F.coalesce(F.avg("share"), F.lit(1.0))).first()
    return int(r[0]), float(r[1])


def duplicates(
    vecs: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    threshold: float = THRESHOLD,
    shard: int = SHARD,
    branch: int = BRANCH,
    pool: int = POOL,
    degree: int = DEGREE,
    alpha: float = ALPHA,
    beam: int = BEAM,
    together: int = TOGETHER,
    block: int = BLOCK,
    audited: int = AUDIT,
    recall: float = RECALL,
) -> DataFrame:
    """(vec_id, kept_vec_id) for each row that is a copy or near copy of a row kept.

    Near copies have a cosine similarity of threshold or more, verified in double precision; groups
    are linked transitively and keep the smallest id. Every row is searched for. The recall is
    audited by brute force for audited points over all rows; where less than recall of their
    partners is found, all searches are made again with twice the beam, until it is. When even a
    beam as wide as the table doesn't reach it, that is an error.

    * Rows with a null id, or a vector that is null, empty, or holds a null, NaN or infinite number are
      copies of nothing. Vectors of each length are compared among themselves.
    * Equal vectors are always copies; a zero vector is a copy of other zero vectors only.
    * Repeated rows alike in id and vector count once and aren't listed for it. Of one id with
      different vectors, a row is listed when its group keeps a smaller id.
    * An empty table gives an empty table. Other columns aren't read.
    """
    how = (threshold, shard, branch, pool, degree, alpha, beam, together, block, audited, recall)
    out = [_duplicates(pts, *how) for pts, _ in points(vecs, vec_id, embedding)]
    return reduce(DataFrame.unionByName, out) if out else vecs.sparkSession.createDataFrame([], "vec_id bigint, kept_vec_id bigint")


def _duplicates(pts: DataFrame, threshold: float, shard: int, branch: int, pool: int, degree: int, alpha: float, beam: int, together: int, block: int, audited: int, recall: float) -> DataFrame:
    spark = pts.sparkSession
    rows = pts.select("id", F.transform("v", lambda x: x + F.lit(0).cast("float")).alias("v")).withColumn("h", F.xxhash64("v"))  # -0 is 0
    uniq = cut(rows.groupBy("v", "h").agg(F.min("id").alias("id")))
    tree = cluster(uniq, shard, branch)
    get = shared(spark, tree)

    def place(v: pd.Series, h: pd.Series) -> pd.DataFrame:
        two = get().two(unit(stack(v)), h.to_numpy() & (1 << 62) - 1) if len(v) else np.empty((0, 2), np.int64)
        return pd.DataFrame({"c1": two[:, 0], "c2": two[:, 1]})

    found = uniq.withColumn("c", F.pandas_udf(place, "c1 bigint, c2 bigint")("v", "h")).select("id", "v", "h", "c.c1", "c.c2")
    parts = max(1, -(-uniq.count() // block))
    ordered = cut(found.repartitionByRange(parts, "c1", "c2", "h").sortWithinPartitions("c1", "c2", "h", "id"))
    folder = new_folder(spark, "vectors")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [stack(pdf["v"]) for pdf in batches if len(pdf)]
        if held:
            part = TaskContext.get().partitionId()
            yield pd.DataFrame([(part, sum(map(len, held)), sharedfile.put(folder, f"x{part}", np.concatenate(held)))], columns=["part", "n", "x"])

    blocks = sorted(ordered.select("v").mapInPandas(write, "part int, n bigint, x string").collect())
    starts = np.concatenate([[0], np.cumsum([b.n for b in blocks])])[:-1].astype(np.int64).tolist()
    begin = {b.part: s for b, s in zip(blocks, starts)}

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = begin.get(TaskContext.get().partitionId(), 0)
        for pdf in batches:
            pdf.insert(0, "g", np.arange(at, at + len(pdf)))
            at += len(pdf)
            yield pdf

    placed = cut(ordered.mapInPandas(number, "g bigint, id bigint, v array<float>, h bigint, c1 bigint, c2 bigint"))
    graph = build(spark, placed, starts, [b.x for b in blocks], pool, degree, alpha, shard)
    n = sum(b.n for b in blocks)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 20_000))
    queries = placed.select("g", "c1", "c2").repartitionByRange(tasks, "g").sortWithinPartitions("g")
    while True:
        group = components(edges_of(spark, queries, graph, threshold, beam, together), "a", "b")
        there, share = audit(placed, group, threshold, audited)
        if share >= recall:
            break
        if beam >= n:
            raise RuntimeError(f"only {share:.3f} of the near copies of {there} audited points are found")
        beam *= 2
    comp = placed.join(group.withColumnRenamed("node", "g"), "g", "left").select("h", "id", "v", F.coalesce("component", "g").alias("c"))
    kept = comp.groupBy("c").agg(F.min("id").alias("kept_vec_id"))
    per = comp.join(kept, "c").select("h", F.col("v").alias("_v"), "kept_vec_id")
    out = rows.join(per, "h").filter(F.col("v") == F.col("_v"))
    return out.filter(F.col("id") != F.col("kept_vec_id")).select(F.col("id").alias("vec_id"), "kept_vec_id")


def query(spark, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: By all pairs.
SQL = f"""
WITH RECURSIVE e AS (
  SELECT DISTINCT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings
), pairs AS (
  SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}
), links AS (
  SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
), reach AS (
  SELECT a AS id, b AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT id AS vec_id, min(other) AS kept_vec_id FROM reach GROUP BY id HAVING min(other) < id
"""
