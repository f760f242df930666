"""Language ID: the score against a plain statement of it, and held-out accuracy."""

from collections import Counter

import numpy as np
import pytest

from quire.llm import langid


def test_backoff_is_word_first():
    m = langid.Backoff({"a": Counter({"foo": 5, "bar": 3}), "b": Counter({"foo": 1, "qux": 4})}, max_n=2)
    assert np.allclose(m.word("foo"), np.log([(5.5) / (8 + 1.5), 1.5 / (5 + 1.5)]))

    def grams(w, counts, k):
        w = f"\x02{w}\x03"
        return Counter({w[i : i + k]: 0 for i in range(len(w) - k + 1)}) + Counter(w[i : i + k] for i in range(len(w) - k + 1))

    # unseen: longest known n-gram from the left
    used, i, s = [], 0, "\x02fox\x03"
    while i < len(s):
        for k in (2, 1):
            if s[i : i + k] in m.grams and len(s[i : i + k]) == k:
                used.append(m.grams[s[i : i + k]])
                i += k
                break
        else:
            i += 1
    assert np.allclose(m.word("fox"), m.gram_logs[used].sum(0))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 40")
    half = "pmod(xxhash64(text), 2)"
    model = langid.train(docs.filter(f"{half} = 0"), sample=150)
    out = langid.identify(docs.filter(f"{half} = 1"), model).select("lang", "language").collect()
    right = sum(r.lang == r.language for r in out) / len(out)
    assert right > 0.95


def test_cases(spark):
    rows = [(1, "the cat and the dog", "en", "k"), (2, "le chat et le chien", "fr", "k"), (3, None, "en", "k"), (4, "", None, "k"), (5, "12 34 !!", "en", "k"), (None, "the dog " * 50_000, None, "k"), (1, "the cat and the dog", "en", "k"), (7, "le chien et le chat", "en", "k"), (8, "the the the", "xx", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, language string")
    model = langid.Backoff({"en": Counter("the cat and the dog the cat and the dog".split()), "fr": Counter("le chat et le chien le chat et le chien".split())})
    out = langid.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "language", "_language", "margin", "accepted"]
    got = [(r.doc_id, r._language, r.accepted) for r in out.collect()]
    assert got == [(1, "en", True), (2, "fr", True), (3, "und", False), (4, "und", False), (5, "und", False), (None, "en", True), (1, "en", True), (7, "fr", True), (8, "en", True)]
    kept = langid.language_filter(docs, model, refutes=0.0)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "8", "None"]
    claims = spark.createDataFrame([(1, "the cat and the dog", "fr"), (2, "le chat et the dog", "en")], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.language_filter(claims, model, refutes=1.0).collect()] == [2]  # mixed text keeps its claim
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.language_filter(docs.limit(0)).count() == 0


def test_runs_against_brute_force():
    from itertools import product

    rng = np.random.default_rng(3)
    for claim in (0, 1, 2):
        scores = rng.normal(0, 2, (7, 3))
        cost = lambda p: sum(scores[i, g] for i, g in enumerate(p)) - 2.0 * sum(a != b for a, b in zip((claim, *p), p))
        best = max(product(range(3), repeat=7), key=cost)
        assert langid.against(scores, claim, 2.0) == sum(g != claim for g in best) / 7
    assert langid.against(np.zeros((5, 2)), 1) == 0


def test_claims_at_the_production_default(spark):
    en, fr = "the cat and the dog in house of my old friend".split(), "le chat et le chien dans maison de mon vieil ami".split()
    model = langid.Backoff({"en": Counter(en * 9), "fr": Counter(fr * 9)})
    text = lambda n, k: "\n".join([" ".join(en)] * n + [" ".join(fr)] * k)
    rows = [(1, text(9, 1), "fr"), (2, text(3, 7), "fr"), (3, text(6, 4), "fr"), (4, text(4, 6), "fr"), (5, text(10, 0), "fr"), (6, "the", "fr"), (7, text(9, 1), "en"), (8, text(9, 1), "xx"), (9, text(9, 1), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert 0 < langid.identify(docs.filter("doc_id = 1"), model).first().margin < 4
    assert sorted(r.doc_id for r in langid.language_filter(docs, model).collect()) == [2, 4, 6, 7, 8, 9]


@pytest.mark.parametrize("n", [5, 20])
def test_sample_is_bounded(spark, n):
    docs = spark.range(500).selectExpr("concat('word', id) AS text", "IF(id % 3 = 0, 'a', 'b') AS lang")
    assert {r.lang: r["count"] for r in langid.sample_of(docs, sample=n).groupBy("lang").count().collect()} == {"a": n, "b": n}


def test_sample_takes_texts_not_rows(spark):
    few = spark.range(10_000).selectExpr("concat('mot', id % 5) AS text", "'a' AS lang")
    none = spark.range(10_000).selectExpr("IF(id < 3, concat('wort', id), IF(id % 2 = 0, NULL, '')) AS text", "'b' AS lang")
    many = spark.range(3_000).selectExpr("concat('word', IF(id < 2000, id % 4, id)) AS text", "'c' AS lang")
    got = langid.sample_of(few.union(none).union(many)).collect()
    assert len({(r.lang, r.text) for r in got}) == len(got)
    assert Counter(r.lang for r in got) == {"a": 5, "b": 3, "c": langid.SAMPLE}


def brute_identify(counts, text, max_n=langid.MAX_N, min_count=langid.MIN_COUNT):
    """(language, margin, accepted) of a text by the counts of words (language -> Counter), from first principles."""
    from math import log

    langs = sorted(counts)
    vocabulary = {w for c in counts.values() for w in c}
    known = {w for w in vocabulary if sum(c[w] for c in counts.values()) >= min_count}
    grams = {g: Counter() for g in langs}
    for g in langs:
        for w, n in counts[g].items():
            marked = f"\x02{w}\x03"
            for k in range(1, max_n + 1):
                for i in range(len(marked) - k + 1):
                    grams[g][marked[i : i + k]] += n
    every = {m for g in langs for m in grams[g]}
    kinds = Counter(len(m) for m in every)

    def of_word(w, g):
        if w in known:
            return log((counts[g][w] + 0.5) / (sum(counts[g].values()) + 0.5 * len(known)))
        marked, total = f"\x02{w}\x03", 0.0
        while marked:
            fits = [k for k in range(min(max_n, len(marked)), 0, -1) if sum(grams[h][marked[:k]] for h in langs) >= min_count]
            if fits:
                k = fits[0]
                n = sum(v for m, v in grams[g].items() if len(m) == k)
                total += log((grams[g][marked[:k]] + 0.5) / (n + 0.5 * kinds[k]))
            marked = marked[fits[0] if fits else 1 :]
        return total

    words = [w for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()]
    if not words:
        return langid.UNKNOWN, 0.0, False
    per = {w: {g: of_word(w, g) for g in langs} for w in set(words)}
    total = {g: sum(per[w][g] for w in words) for g in langs}
    best = max(langs, key=lambda g: (total[g], [-ord(c) for c in g]))
    margin = (total[best] - max(total[g] for g in langs if g != best)) / len(words)
    return best, margin, margin >= langid.MIN_MARGIN and sum(map(len, words)) / len("".join(text.split())) >= langid.MIN_LETTERS


def test_identify_against_brute_force(spark):
    """Few counts, so that most words fall back to n-grams of all lengths."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    counts = {}
    for r in rows[::7]:
        counts.setdefault(r.lang, Counter()).update(langid.words_of(" ".join(r.text.split()[:12])))
    model = langid.Backoff(counts)
    some = spark.createDataFrame([(r.doc_id, r.text[:600]) for r in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(some, model).collect()}
    for r in some.collect():
        lang, margin, ok = brute_identify(counts, r.text)
        x = got[r.doc_id]
        assert (x.language, x.accepted) == (lang, ok) and x.margin == pytest.approx(margin, abs=1e-9)


def test_ties_go_to_the_first_by_name(spark):
    same = Counter({"a": 3, "b": 2})
    out = langid.identify(spark.createDataFrame([("a b",)], "text string"), langid.Backoff({"y": same, "x": same, "z": same})).first()
    assert (out.language, out.margin, out.accepted) == ("x", 0.0, False)
