"""Line dedup against sets in Python."""

import re

import pytest

from quire.llm import linededup


def brute(rows, most, count="documents"):
    """The texts of rows (doc_id, text)."""
    norm = lambda x: re.sub(r"[ \t\r\f]+", " ", x).strip(" ").lower()
    have = {}
    for _, t in {(i if count == "documents" else 0, t) for i, t in rows if t is not None}:
        for x in {norm(x) for x in t.split("\n")} - {""}:
            have[x] = have.get(x, 0) + 1
    return [None if t is None else "\n".join(x for x in t.split("\n") if have.get(norm(x), 0) <= most) for _, t in rows]


@pytest.mark.parametrize("count", ["documents", "texts"])
def test_against_brute_force(spark, count):
    texts = [f"own {i}\nShared  LINE\n\n" + ("rare\n" if i < 3 else "") + "shared line\nend" for i in range(12)] + ["same\nrare"] * 30 + [None, ""]
    rows = [*enumerate(texts), *[(77, "twice")] * 9, *[(None, "none")] * 9]
    got = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), max_docs=4, count=count).collect()
    assert sorted(got, key=str) == sorted(zip((i for i, _ in rows), brute(rows, 4, count)), key=str)
    same = {r.text for r in got if r.doc_id in range(12, 42)}
    assert same == ({""} if count == "documents" else {"same\nrare"})  # copies count, or count once
    assert {r.text for r in got if r.doc_id in (77, None)} == {"twice", "none"}  # repeated rows are one document


def test_cases(spark):
    rows = [(1, "x\n" * 100_000 + "y", "a"), (2, None, "b"), (2, None, "b"), (None, "", "c")] + [(10 + i, f"x\n{i}", "d") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, drop string")
    out = linededup.line_dedup(docs, dropped="n")
    assert out.columns == ["doc_id", "text", "drop", "n"] and out.count() == len(rows)
    got = {r.doc_id: (r.text, r.n) for r in out.collect()}
    assert got[1] == ("y", 100_000) and got[2] == (None, 0) and got[None] == ("", 0) and got[10] == ("0", 1)
    assert linededup.line_dedup(docs.limit(0)).count() == 0
