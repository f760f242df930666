"""Options of edits that are another for each file."""

import pandas as pd

from quire.operators import pdfsets


def counted(monkeypatch, owner, name):
    """The calls of a function from now on."""
    calls, fn = [], getattr(owner, name)
    monkeypatch.setattr(owner, name, lambda *a, **k: calls.append(a) or fn(*a, **k))
    return calls


def test_options_of_structs_come_as_dicts(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(b"x").alias("content"), F.struct(F.col("id"), F.concat(F.lit("n"), "id").alias("name"), (F.col("id") / 2).alias("half")).alias("s"), F.array(F.struct("id")).alias("a"))
    out = pdfsets.edited(rows, lambda c, s, a, t: repr((s, [x["id"] for x in a], t)).encode(), s=F.col("s"), a=F.col("a"), t="t")
    said = [bytes(r.content).decode() for r in out.orderBy("doc_id").collect()]
    assert said == [repr(({"id": i, "name": f"n{i}", "half": i / 2}, [i], "t")) for i in range(3)]


def test_structs_are_turned_into_dicts_as_a_whole(monkeypatch):
    calls = counted(monkeypatch, pd.Series, "to_dict")
    fields = pd.DataFrame({"a": ["x", "y"], "n": [1, 2]})
    held = {}
    monkeypatch.setattr(pdfsets.F, "pandas_udf", lambda fn, schema: held.setdefault("run", fn) and type("U", (), {"asNondeterministic": lambda self: lambda *c: None})())
    from unittest.mock import MagicMock

    from pyspark.sql import Column

    col = MagicMock(spec=Column)
    pdfsets.edited(MagicMock(), lambda c, v: repr(v).encode(), v=col)
    made = held["run"](pd.Series([b"1", b"2"]), fields)
    assert made["content"].tolist() == [b"{'a': 'x', 'n': 1}", b"{'a': 'y', 'n': 2}"] and not calls
