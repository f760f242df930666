"""Pages are folded few at a time, and what a page needs is had without pairs, pandas groups or wide joins."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from quire.operators import layout
from quire.operators.lines import PAGES_AT_ONCE, sliced
from quire.plans import registry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_few_pages_are_python_objects_at_a_time():
    seen = []

    class Column:
        def __init__(self, a):
            self.a = a

        def __len__(self):
            return len(self.a)

        def slice(self, at, n):
            seen.append(n)
            return self.a.slice(at, n)

    rows = [[{"x": i}] for i in range(3 * PAGES_AT_ONCE + 1)]
    type_ = pa.list_(pa.struct([("x", pa.int64())]))
    made = sliced(lambda page: [{"x": page[0]["x"] + 1}], type_, Column(pa.array(rows, type=type_)))
    assert made.to_pylist() == [[{"x": i + 1}] for i in range(len(rows))] and max(seen) == PAGES_AT_ONCE
    assert sliced(lambda page: page, type_, pa.array([], type=type_)).to_pylist() == []


def test_no_pandas_group_for_a_page(spark):
    assert "FlatMapGroupsInPandas" not in plan(spark, "greedy_match")
    assert "ArrowEvalPython" in plan(spark, "group_spans")


def test_projection_has_no_join(spark):
    assert "Join" not in plan(spark, "x_projection")


def test_cover_counts_every_point(spark):
    random.seed(3)
    rows = [(i, [(a, a + random.randint(0, 30)) for a in (random.randint(-5, 60) for _ in range(random.randint(0, 9)))]) for i in range(50)]
    found = spark.createDataFrame(rows, "id int, _ext array<struct<a:bigint,b:bigint>>").withColumn("c", layout.cover(F.lit(3), F.lit(50))).collect()
    for r in found:
        assert [n for x in r.c for n in [x.n] * (x.i1 - x.i0)] == [sum(a <= i < b for a, b in r._ext) for i in range(3, 50)]
