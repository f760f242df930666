"""Near-dedup against brute force over all pairs."""

import random

import pytest

from quire.llm import minhash


def brute(rows, threshold=minhash.THRESHOLD):
    """(doc_id, kept) as duplicates() defines them, by all pairs."""
    memo = minhash._Hashes()
    texts = sorted({t for _, t in rows if t is not None})
    sets = {t: minhash.shingles(t, memo) for t in texts}
    up = {t: t for t in texts}

    def top(t):
        while up[t] != t:
            t = up[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if len(sets[a]) and len(sets[b]) and minhash.jaccard(sets[a], sets[b]) >= threshold:
                up[top(a)] = top(b)
    groups = {}
    for i, t in rows:
        if t is not None:
            groups.setdefault(top(t), []).append((i, t))
    out = []
    for g in groups.values():
        keep = min(i for i, _ in g)
        out += [(i, keep) for i in sorted(i for i, _ in g)[1:]]
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.choice([3, 30, 120, 600]))] for _ in range(25)]
    passage = [r.choice(words) for _ in range(60)]
    rows = []
    for i in range(140):
        t = list(r.choice(base)) if r.random() < 0.6 else [r.choice(words) for _ in range(r.choice([1, 5, 80, 300]))]
        if r.random() < 0.4:
            t = t + passage
        for _ in range(r.choice([0, 0, 1, 4])):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash.duplicates(docs).collect()))
    want = brute(rows)
    both = set(got) & set(want)
    assert not set(got) - set(want)  # verified exactly
    assert len(both) >= 0.97 * len(want)  # pairs at the very threshold may fall below the estimate


@pytest.mark.parametrize("how", [{"task_shingles": 1}, {"rounds": 0}, {"rounds": 4}, {"task_shingles": 1, "rounds": 0}])
def test_other_ways_give_the_same(spark, how):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(minhash.duplicates(docs, **how).collect()) == sorted(minhash.duplicates(docs).collect())


def test_lists_hold_every_pair_of_enough_estimate(spark):
    """All pairs by brute force; with leading values only on one side."""
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sk = minhash.sketches(minhash.texts_of(docs, "text", "doc_id"))
    lists = minhash.inverted(sk).collect()
    by_value = {}
    for r in lists:
        by_value.setdefault(r.v, []).append(r)
    pairs = {(min(x.node, y.node), max(x.node, y.node)) for l in by_value.values() for x in l if x.leads for y in l if x.node != y.node}
    s = {r.node: minhash.np.array(sorted(r.s)) for r in sk.collect()}
    nodes = sorted(s)
    near = {(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if minhash.estimate_of(s[a], s[b]) >= minhash.ESTIMATE}
    assert near and near <= pairs


def test_edges_of_a_cluster_grow_with_its_nodes(spark):
    """Pages of one template make about as many pairs as pages, and copies of one text reach the verification once."""
    r = random.Random(5)
    page = [f"t{i}" for i in range(100)]
    texts = [" ".join([*page, *(f"u{r.randrange(10**9)}" for _ in range(3))]) for _ in range(1500)]
    docs = spark.createDataFrame([*enumerate(texts), *((5000 + i, texts[0]) for i in range(5000))], "doc_id long, text string")
    made = []
    sk = minhash.sketches(minhash.texts_of(docs, "text", "doc_id"))
    assert sk.count() == 1500

    def compare(pairs):
        made.append(pairs.count())
        return minhash.estimated(pairs, sk)

    minhash.linked(minhash.inverted(sk), compare)
    assert 1499 <= sum(made) < 10 * 1500
    assert minhash.duplicates(docs).count() == 6499


def test_passages_lead_in_no_list(spark):
    """Texts of which half is one passage make no pairs, though they share half of their sketches."""
    r = random.Random(6)
    passage = [f"p{i}" for i in range(100)]
    docs = spark.createDataFrame([(i, " ".join([*passage, *(f"u{r.randrange(10**9)}" for _ in range(130))])) for i in range(60)], "doc_id long, text string")
    lists = minhash.inverted(minhash.sketches(minhash.texts_of(docs, "text", "doc_id")))
    assert lists.filter("leads").select("node").distinct().count() < 15
    assert minhash.duplicates(docs).count() == 0


def test_groups_of_sets():
    r = random.Random(8)
    for _ in range(40):
        base = [set(r.sample(range(10**6), 40)) for _ in range(4)]
        sets = []
        for _ in range(r.choice([2, 3, 9, 30])):
            b = set(r.choice(base))
            b -= set(r.sample(sorted(b), r.choice([0, 5, 12])))
            sets.append(minhash.np.array(sorted(b | set(r.sample(range(10**6), r.choice([0, 4, 10])))), dtype="int64"))
        label = minhash.grouped(sets)
        want = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j in range(i):
                if minhash.jaccard(a, sets[j]) >= minhash.THRESHOLD and minhash.estimate_of(a, sets[j]) >= minhash.ESTIMATE:
                    x, y = sorted((want[i], want[j]))
                    want = [x if w == y else w for w in want]
        assert label.tolist() == want


def test_cases(spark):
    long = " ".join(f"x{i % 5000}" for i in range(60_000))
    rows = [(1, None, "a"), (2, "", "b"), (3, "", "c"), (4, "hi there", None), (4, "hi there", None), (5, "Hi, there", "d"), (None, long, "e"), (7, long + " end", "f"), (8, "...", "g"), (9, "!!!", "h"), (1, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(map(tuple, minhash.duplicates(docs).collect()), key=str)
    assert got == sorted([(3, 2), (4, 4), (5, 4), (None, 7)], key=str)
    kept = minhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 1, 2, 4, 7, 8, 9]
    assert minhash.duplicates(docs.limit(0)).count() == 0 and minhash.near_dedup(docs.limit(0)).count() == 0
