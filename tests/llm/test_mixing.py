"""Weighted fair queueing against a simple queue."""

import hashlib

from quire.llm import mixing


def brute(rows, weights, default, budget):
    queue = {}
    for i, s, t in rows:
        th = hashlib.md5((t or "").encode()).hexdigest()
        queue[i, s, th] = queue.get((i, s, th), 0) + len((t or "").split())
    by = {}
    for (i, s, th), n in queue.items():
        key = hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}:{th}".encode()).hexdigest()
        by.setdefault(s, []).append((key, i, n))
    done = []
    for s, q in by.items():
        cum = 0
        for key, i, n in sorted(q, key=lambda x: x[0]):
            cum += n
            done.append((cum / weights.get(s, default), key, s or "", s is None, i, n))
    out, total = [], 0
    for f, _, s, null, i, n in sorted(done, key=lambda x: x[:4]):
        total += n
        if total <= budget:
            out.append((i, None if null else s, n, round(f, 6), total))
    return out


def test_against_brute_force(spark):
    rows = [(i, f"src{i % 4}" if i % 9 else None, " ".join(["w"] * (i * 7 % 23))) for i in range(300)] + [(5, "src1", "w w"), (5, "src1", "w w")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    total = sum(len(t.split()) for _, _, t in rows)
    got = [(r.doc_id, r.source, r.n_tokens, round(r.finish, 6), r.total) for r in mixing.fair_queue(docs, ranges=16).collect()]
    want = brute(rows, mixing.WEIGHTS, 1.0, int(total * mixing.BUDGET_SHARE))
    assert sorted(got, key=lambda r: (r[4], str(r))) == sorted(want, key=lambda r: (r[4], str(r)))


def test_shares_follow_the_weights(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'a', 'b') AS source", "repeat('w ', 10) AS text")
    out = mixing.fair_queue(docs, {"a": 3.0, "b": 1.0}, budget=8000).groupBy("source").sum("n_tokens").collect()
    sums = dict(map(tuple, out))
    assert abs(sums["a"] / sums["b"] - 3) < 0.05


def test_cases(spark):
    rows = [(1, None, None, "x"), (None, "s", "", "y"), (2, "s", "a b c", None), (2, "s", "a b c", "q"), (3, "s", "w " * 100_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, total string")
    out = mixing.mix(docs, budget_share=1.0)
    assert out.columns == docs.columns and out.count() == 5
    none = mixing.mix(docs, budget=0).collect()
    assert all(not (r.text or "").strip() for r in none)
    few = mixing.mix(docs, budget=6)
    assert few.filter("doc_id = 2").count() == 2 or few.filter("doc_id = 3").count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0
