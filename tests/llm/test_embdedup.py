"""Embedding near-dedup against all pairs."""

import numpy as np
import pytest

from quire.llm import embdedup


def brute(x, ids, threshold=embdedup.THRESHOLD):
    u = x.astype(np.float64)
    n = np.linalg.norm(u, axis=1, keepdims=True)
    s = (u / np.where(n > 0, n, 1)) @ (u / np.where(n > 0, n, 1)).T
    f = embdedup.Forest()
    for a, b in zip(*np.nonzero(np.triu(s >= threshold, 1) | np.triu((x[:, None] == x[None]).all(2), 1))):
        f.add(int(a), int(b))
    keep = {}
    for i in range(len(x)):
        keep[f.top(i)] = min(keep.get(f.top(i), ids[i]), ids[i])
    return {(int(ids[i]), int(keep[f.top(i)])) for i in range(len(x)) if keep[f.top(i)] != ids[i]}


def data(n=2500, dim=24):
    r = np.random.RandomState(1)
    x = r.standard_normal((n, dim)).astype(np.float32)
    for k in range(0, 400, 4):  # pairs, one of another length
        x[k + 1] = 3 * (x[k] + 0.05 * r.standard_normal(dim))
    x[500:900] = x[500] + 0.08 * r.standard_normal((400, dim))  # a group larger than a shard
    x[950:960] = x[950]
    x[970:973] = 0
    return x


def test_against_brute_force(spark):
    x = data()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = set(map(tuple, embdedup.duplicates(df, shard=200, block=700).collect()))
    want = brute(x, np.arange(len(x)))
    assert not got - want
    assert len(got) >= 0.95 * len(want)


def test_shards_are_bounded_and_recall_is_reached(spark, monkeypatch):
    """Points second nearest to one cluster are spread; an audit that can't be met is an error."""
    x = data(1200)
    x[300:800] = x[300] + 0.6 * np.random.RandomState(2).standard_normal((500, x.shape[1]))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    sizes, real = [], embdedup.build

    def build(spark, placed, starts, vectors, pool, degree, alpha, shard):
        first = {r.c1: r["count"] for r in placed.groupBy("c1").count().collect()}
        second = {r.c2: r["count"] for r in placed.filter("c1 <> c2").groupBy("c2").count().collect()}
        sizes.extend((first[c], second.get(c, 0)) for c in first)
        return real(spark, placed, starts, vectors, pool, degree, alpha, shard)

    monkeypatch.setattr(embdedup, "build", build)
    got = set(map(tuple, embdedup.duplicates(df, shard=60, block=500).collect()))
    want = brute(x, np.arange(len(x)))
    assert not got - want and len(got) >= 0.95 * len(want)
    assert max(b for _, b in sizes) > 60
    monkeypatch.setattr(embdedup, "audit", lambda *a: (1, 0.5))
    with pytest.raises(RuntimeError):
        embdedup.duplicates(df.limit(20))


def test_every_length_is_searched(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 5.0, 0.0]), (4, [0.0, 1.0, 0.01]), (5, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embdedup.duplicates(df).collect())) == [(2, 1), (4, 3)]


def test_pruning_keeps_the_nearest():
    x = embdedup.unit(data()[:300])
    lists, medoid = embdedup.pruned(x)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    for i, near in enumerate(lists):
        assert i not in near
        assert s[i].argmax() in near or s[i, near].max() >= s[i].max() - 1e-6
    seen, todo = {medoid}, [medoid]
    while todo:
        for j in lists[todo.pop()]:
            if j not in seen:
                seen.add(j)
                todo.append(j)
    assert len(seen) >= 290


def test_joined_edges_join_the_same():
    at, i, g = np.array([10, 11, 12, 13]), np.array([0, 0, 1, 3, 3]), np.array([50, 11, 50, 60, 61])
    f, h = embdedup.Forest(), embdedup.Forest()
    for a, b in zip(at[i], g):
        f.add(int(a), int(b))
    for a, b in zip(*embdedup.joined(at, i, g)):
        h.add(int(a), int(b))
    names = [10, 11, 12, 13, 50, 60, 61]
    assert [f.top(n) == f.top(m) for n in names for m in names] == [h.top(n) == h.top(m) for n in names for m in names]


def test_cases(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.01], "b"), (2, [2.0, 0.01], "b"), (3, [0.0, 1.0], "c"), (4, [0.0, 0.0], "d"), (5, [-0.0, 0.0], "e"), (None, [1.0, 0.0], "f"), (6, None, "g"), (7, [1.0], "h"), (8, [nan, 0.0], "i"), (9, [], "j")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, h string")
    assert sorted(map(tuple, embdedup.duplicates(df).collect())) == [(2, 1), (5, 4)]
    assert embdedup.duplicates(df.limit(0)).count() == 0
    assert embdedup.duplicates(df.filter("vec_id = 3")).count() == 0
