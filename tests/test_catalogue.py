"""Every query of the core against its SQL, on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from oodmill.plans import catalogue


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def tidy(v):
        if isinstance(v, (datetime.datetime, datetime.date)):
            return str(v)
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return str(v)
        if isinstance(v, (int, float, decimal.Decimal)):
            return f"{float(v):.6f}"
        return str(v)

    return [columns[i] for i in order], sorted(tuple(tidy(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_matches_sql(name, spark, sf, duck):
    df = catalogue.queries()[name](spark, sf)
    got = rows(df.columns, df.collect())
    rel = duck.sql(catalogue.oracles()[name])
    assert got == rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracles())))
def test_runs(name, spark, sf):
    df = catalogue.queries()[name](spark, sf)
    got = df.collect()
    assert got and all(any(v is not None for v in r) for r in got) and len(set(df.columns)) == len(df.columns)


def test_every_oracle_has_a_query():
    assert set(catalogue.oracles()) <= set(catalogue.queries())
