"""Every query with SQL, against that SQL in DuckDB."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path(data).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def clean(v):
    return None if isinstance(v, float) and math.isnan(v) else 0.0 if v == 0 and isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, db, data, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = Counter(tuple(clean(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    r = db.execute(ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    want = Counter(tuple(clean(row[names.index(c)]) for c in columns) for row in r.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
