"""Every query with an SQL twin gives the same rows as DuckDB does."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from quire.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6) + 0.0
    return bytes(v) if isinstance(v, bytearray) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, name):
    df = registry.queries()[name](spark, SF)
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    want, got = rows(names, cur.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    assert next(((g, w) for g, w in zip(got, want) if g != w), None) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLE)))
def test_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    df.collect()
    assert df.columns
