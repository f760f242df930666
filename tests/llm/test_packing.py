"""Best-two-fit against an exhaustive statement of the rule, and an exact round trip."""

import random

from quire.llm import packing


def brute(lengths, size):
    left = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins = []
    while left:
        b, gap = [], size
        for i in list(left):
            if lengths[i] <= gap:
                b.append(lengths[i])
                gap -= lengths[i]
                left.remove(i)
        small = b[-1]
        pairs = [(lengths[i] + lengths[j], lengths[i], i, j) for x, i in enumerate(left) for j in left[x + 1 :] if small < lengths[i] + lengths[j] <= small + gap]
        if pairs:
            total, longest = max(p[0] for p in pairs), 0
            longest = max(p[1] for p in pairs if p[0] == total)
            b[-1:] = [longest, total - longest]
            for n in (longest, total - longest):
                left.remove(next(i for i in left if lengths[i] == n))
            lengths.append(small)
            left.append(len(lengths) - 1)
            left.sort(key=lambda i: (-lengths[i], i))
        bins.append(b)
    return bins


def test_against_brute_force():
    r = random.Random(4)
    for _ in range(60):
        size = r.choice([10, 37, 100])
        lengths = [r.randint(1, size) for _ in range(r.randint(0, 40))]
        got = [[lengths[i] for i in b] for b in packing.best_two_fit(lengths, size)]
        assert got == brute(list(lengths), size)


def test_round_trip(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.query(spark, sf).collect()
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r.pos)
        pieces.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.piece))
    sums = {}
    for r in rows:
        sums[r.bin_id] = sums.get(r.bin_id, 0) + r.n_tokens
    assert max(sums.values()) <= packing.LENGTH and all(sorted(p) == list(range(len(p))) for p in bins.values())
    for d in docs.collect():
        at = 0
        for start, n, piece in sorted(pieces.get(d.doc_id, [])):
            assert start == at
            at += n
        assert at == len(d.text.split())
    total = sum(sums.values())
    assert len(bins) <= 1.05 * total / packing.LENGTH + 1


def test_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b", "z"), (3, "a b", "z"), (None, "w " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    out = packing.pack(docs).collect()
    assert sorted((str(r.doc_id), r.piece, r.n_tokens) for r in out) == [("3", 0, 2), ("3", 0, 2), ("None", 0, 2048), ("None", 1, 2048), ("None", 2, 904)]
    assert packing.pack(docs.limit(0)).count() == 0


def test_many_shards(spark):
    """Each shard is packed on its own by the rule; together they hold all pieces once."""
    r = random.Random(9)
    rows = [(i if i % 11 else None, "w " * r.choice([1, 5, 30, 63, 64, 65, 200])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack(docs, length=64, shard=40).collect()
    shards = {}
    for x in out:
        shards.setdefault(x.bin_id >> 32, []).append(x)
    assert 8 < len(shards) < 30
    for own in shards.values():
        pieces = sorted(own, key=lambda x: (x.doc_id is not None, x.doc_id or 0, x.piece, x.n_tokens))
        want = packing.best_two_fit([x.n_tokens for x in pieces], 64)
        bins = {}
        for x in sorted(own, key=lambda x: x.pos):
            bins.setdefault(x.bin_id, []).append(x.n_tokens)
        assert sorted(bins.values()) == sorted([pieces[i].n_tokens for i in b] for b in want)
    whole = sorted((str(x.doc_id), x.n_tokens) for x in out)
    assert whole == sorted((str(i), min(64, len(t.split()) - p)) for i, t in rows for p in range(0, len(t.split()), 64))
