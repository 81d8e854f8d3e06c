"""Every query with SQL equals DuckDB's answer on the smallest data."""

import pathlib

import duckdb
import pytest

from keyloom.plans.catalog import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in pathlib.Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(values):
    text = lambda x: "\0" if x is None else repr(round(float(x), 6)) if isinstance(x, float) else str(x)
    return sorted([text(x) for x in r] for r in values)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    want = con.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.select(*[f"`{n}`" for n in names]).collect()) == rows(want.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
