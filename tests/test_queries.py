"""Every registered query of the engine against its oracle SQL on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from brightloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_oracle(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    if name not in catalog.oracles():
        assert got
        return
    made = con.execute(catalog.oracles()[name])
    at = [[c[0] for c in made.description].index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in made.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
