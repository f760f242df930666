"""Nearest neighbours against all pairs."""

import numpy as np
import pytest

from quire.llm import ann


def brute(x, ids, k):
    out = {}
    for i in range(len(x)):
        d = ((x.astype(np.float64) - x[i]) ** 2).sum(1)
        d[i] = np.inf
        out[ids[i]] = [(ids[j], round(float(np.sqrt(d[j])), 5)) for j in np.lexsort((ids, d))[:k] if np.isfinite(d[j])]
    return out


def test_quantiles():
    assert ann.chi2_cdf(3.841459, 1) == pytest.approx(0.95, abs=1e-6)
    assert ann.chi2_quantile(0.95, 8) == pytest.approx(15.50731, abs=1e-4)
    assert ann.chi2_cdf(0, 3) == 0 and ann.chi2_cdf(1e9, 3) == 1


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_recall(spark, spread):
    r = np.random.RandomState(0)
    centers = r.standard_normal((12, 24))
    x = (centers[r.randint(0, 12, 1500)] + spread * r.standard_normal((1500, 24))).astype(np.float32)
    x[100:140] = x[100]  # copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = ann.neighbours(df, shard=400, leaf=40).collect()
    want = brute(x, np.arange(1500), ann.K)
    got = {}
    for q in sorted(rows, key=lambda q: (q.vec_id, q.rank)):
        got.setdefault(q.vec_id, []).append((q.neighbour_id, round(q.distance, 5)))
    assert len(got) == 1500 and all(len(v) == ann.K for v in got.values())
    near = sum(len({d for _, d in got[i]} & {d for _, d in want[i]}) and sum(a[1] <= want[i][-1][1] + 1e-5 for a in got[i]) for i in want)
    assert near >= 0.95 * 1500 * ann.K
    assert got[100] == want[100]  # ties by id, at distance 0


def test_query_recall(spark):
    sf = "/root/testdata/sf0.001"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    want = brute(np.stack(t.embedding.to_numpy()), t.vec_id.to_numpy(), ann.K)
    got = {(r.vec_id, r.neighbour_id) for r in ann.query(spark, sf).collect()}
    true = {(i, j) for i, v in want.items() if i % 20 == 0 for j, _ in v}
    assert len(true) == ann.K * len([i for i in t.vec_id if i % 20 == 0]) and len(got) == len(true) and len(got & true) >= 0.95 * len(true)


def test_every_length_is_searched(spark):
    rows = [(i, [float(i), 0.0]) for i in range(6)] + [(10 + i, [float(i * i)]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.neighbour_id) for r in ann.neighbours(df, k=1).collect()}
    assert got == {(0, 1), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (10, 11), (11, 10), (12, 11), (13, 12)}
    assert {r.vec_id for r in ann.neighbours(df, k=1, every=5).collect()} == {0, 5, 10}


def test_cases(spark):
    nan = float("nan")
    rows = [(1, [0.0, 0.0], "a"), (1, [0.0, 0.0], "b"), (1, [5.0, 0.0], "c"), (2, [1.0, 0.0], "d"), (None, [1.0, 1.0], "e"), (3, None, "f"), (4, [], "g"), (5, [1.0], "h"), (6, [nan, 1.0], "i"), (7, [None, 1.0], "j")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = sorted((r.vec_id, r.rank, r.neighbour_id, r.distance) for r in ann.neighbours(df).collect())
    assert got == [(1, 1, 2, 1.0), (1, 1, 2, 4.0), (1, 2, 1, 5.0), (1, 2, 1, 5.0), (2, 1, 1, 1.0), (2, 2, 1, 4.0)]
    assert ann.neighbours(df.limit(0)).count() == 0
    assert ann.neighbours(df.filter("vec_id = 2")).count() == 0
