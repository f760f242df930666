"""Context-tree weighting against a sequential brute force."""

from math import lgamma, log, log2, pi, exp

import numpy as np
import pytest

from quire.llm import ctw


def brute_bits(corpus, text, depth, own=False):
    """Bits of text given the trees of corpus: each decision's P(corpus + bit) / P(corpus), or with own
    P(corpus) / P(corpus - bit)."""
    counts = {}

    def path(ctx, code):
        return [(code, ctx[len(ctx) - d :]) for d in range(depth + 1)]

    def walk(t):
        b = b"\0" * depth + t.encode()
        for i in range(depth, len(b)):
            code = 1
            for k in range(7, -1, -1):
                bit = b[i] >> k & 1
                yield b[i - depth : i], code, bit
                code = code << 1 | bit

    for t in corpus:
        for ctx, code, bit in walk(t):
            for node in path(ctx, code):
                counts.setdefault(node, [0, 0])[bit] += 1

    def pe(n):
        return lgamma(n[0] + 0.5) + lgamma(n[1] + 0.5) - lgamma(n[0] + n[1] + 1) - log(pi)

    def pw(code, ctx):
        n = counts.get((code, ctx), [0, 0])
        if len(ctx) == depth:
            return pe(n)
        kids = sum(pw(code, x) for (c, x) in list(counts) if c == code and len(x) == len(ctx) + 1 and x[1:] == ctx)
        a, b = pe(n), kids
        m = max(a, b)
        return m + log(exp(a - m) + exp(b - m)) - log(2)

    total = 0.0
    for ctx, code, bit in walk(text):
        step = -1 if own else 1
        before = pw(code, b"")
        for node in path(ctx, code):
            counts.setdefault(node, [0, 0])[bit] += step
        total -= step * (pw(code, b"") - before) / log(2)
        for node in path(ctx, code):
            counts[node][bit] -= step
    return total


def test_lgamma():
    x = np.array([0.5, 1.0, 1.5, 3.0, 10.5, 1e3, 1e7 + 0.5])
    assert np.allclose(ctw.lgamma(x), [lgamma(v) for v in x], rtol=1e-12, atol=1e-10)


def test_keys_keep_to_their_text():
    k, starts = ctw.keys_of(["ab", "cde"], 2)
    assert starts.tolist() == [0, 2]
    assert k.tolist() == [97, 97 << 16 | 98, 99, 99 << 16 | 100, 100 << 16 | 99 << 8 | 101]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_against_brute_force(spark, depth):
    texts = ["abracadabra", "abrac é", "zz", "abra"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.bits for r in ctw.score(docs, depth=depth).collect()}
    model = ctw.fit(docs, docs, depth=depth)
    with_own = {r.doc_id: r.bits for r in ctw.score(docs, model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute_bits(texts, t, depth, own=True), rel=1e-5)
        assert with_own[i] == pytest.approx(brute_bits(texts, t, depth), rel=1e-5)


def test_groups_and_files_change_no_score(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one = {r.doc_id: r.bits for r in ctw.score(docs, depth=3).collect()}
    many = {r.doc_id: r.bits for r in ctw.score(docs, depth=3, group_size=500, file_size=3000).collect()}
    assert one == pytest.approx(many, rel=1e-6)


def test_copies_are_told_apart(spark):
    """Of texts of random letters, those that are there twice are cheap, and those that are there once aren't."""
    import random

    r = random.Random(1)
    junk = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(400)) for _ in range(20)]
    prose = [r_.text for r_ in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate([*junk, *junk[:10], *prose])), "doc_id long, text string")
    got = {x.doc_id: x.bits_per_byte for x in ctw.score(docs).collect()}
    assert max(got[i] for i in range(10)) + 1 < min(got[i] for i in range(10, 20))
    assert [got[i] for i in range(10)] == pytest.approx([got[20 + i] for i in range(10)])


def test_depths(spark):
    docs = spark.createDataFrame([("abc",)], "text string")
    for depth in (0, 7):
        with pytest.raises(ValueError):
            ctw.fit(docs, depth=depth)
    model = ctw.fit(docs.limit(0), docs, depth=2)
    assert ctw.score(docs, model).first().bits == pytest.approx(24)


def test_held_out(spark):
    train = spark.createDataFrame([("the cat sat on the mat " * 20,)], "text string")
    held = spark.createDataFrame([("the mat",), ("qxzj vk",)], "text string")
    model = ctw.fit(train, held, depth=3)
    low, high = [r.bits_per_byte for r in ctw.score(held, model).collect()]
    assert low < 2 < high
    assert low * 7 == pytest.approx(brute_bits(["the cat sat on the mat " * 20], "the mat", 3), rel=1e-4)


def test_texts_that_the_model_does_not_know(spark):
    model = ctw.fit(spark.createDataFrame([("abc",)], "text string"))
    with pytest.raises(Exception, match="wasn't fitted"):
        ctw.score(spark.createDataFrame([("abd",)], "text string"), model).collect()


def test_cases(spark):
    rows = [(1, None, "x"), (None, "", "y"), (2, "aa", "z"), (2, "aa", "z"), (3, "b" * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bits string")
    out = ctw.score(docs)
    assert out.columns == ["doc_id", "text", "bits", "n_bytes", "_bits", "bits_per_byte"]
    got = sorted(((r.n_bytes, r._bits, r.bits_per_byte) for r in out.collect()), key=lambda r: r[0])
    assert got[0] == got[1] == (0, 0.0, None)
    assert got[2] == got[3] and got[2][0] == 2 and got[4][0] == 300_000
    assert ctw.score(docs.limit(0)).count() == 0
