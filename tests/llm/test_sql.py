"""The queries with SQL against DuckDB, and the pipeline against its brute-force version."""

import os

import duckdb
import pytest

import corpus_pipeline
from quire.llm import langid, packing, registry
from tests.llm import test_linededup, test_minhash, test_mixing
from quire.llm import mixing
from quire.llm.linededup import MAX_DOCS

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    df = registry.queries()[name](spark, SF).select(*names)
    key = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert sorted(map(repr, map(key, cur.fetchall()))) == sorted(repr(key(tuple(r))) for r in df.collect())


def brute(docs, model):
    """run() for rows (doc_id, text, lang, source), stage by stage."""
    import numpy as np

    kept = []
    for i, t, lang, s in docs:
        words = langid.words_of(t or "")
        if not words:
            continue
        total = np.sum([model.word(w) for w in words], axis=0)
        order = np.argsort(-total, kind="stable")
        margin = (total[order[0]] - total[order[1]]) / len(words)
        letters = sum(map(len, words)) / len("".join(t.split()))
        if margin >= langid.MIN_MARGIN and letters >= langid.MIN_LETTERS and (lang is None or lang not in model.langs or lang == model.langs[order[0]] or margin < langid.REFUTES):
            kept.append((i, t, s))
    texts = test_linededup.brute([(i, t) for i, t, _ in kept], MAX_DOCS, "texts")
    kept = [(i, t, s) for (i, _, s), t in zip(kept, texts)]
    gone = {i for i, _ in test_minhash.brute([(i, t) for i, t, _ in kept])}
    kept = [r for r in kept if r[0] not in gone]
    tokens = sum(len(t.split()) for _, t, _ in kept)
    taken = {r[0] for r in test_mixing.brute([(i, s, t) for i, t, s in kept], mixing.WEIGHTS, mixing.DEFAULT_WEIGHT, int(tokens * mixing.BUDGET_SHARE))}
    pieces = []
    for i, t, _ in sorted(r for r in kept if r[0] in taken):
        n = len(t.split())
        pieces += [(i, p, p * packing.LENGTH, min(packing.LENGTH, n - p * packing.LENGTH)) for p in range(-(-n // packing.LENGTH))]
    bins = packing.best_two_fit([p[3] for p in pieces], packing.LENGTH)
    return sorted((b, k, *pieces[j]) for b, js in enumerate(bins) for k, j in enumerate(js))


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    extra = [("the same line everywhere\n" + r.text) for r in rows[:40]]
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in rows] + [(9000 + i, t, rows[i].lang, rows[i].source) for i, t in enumerate(extra)] + [(9900, None, "en", "src0"), (9901, "", None, None), (9902, "12 !! 34", "en", "src1")]
    df = spark.createDataFrame([(*d, len(d[1]) if d[1] else None) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.bin_id, r.pos, r.doc_id, r.piece, r.start, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == brute(docs, langid.train(df))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
