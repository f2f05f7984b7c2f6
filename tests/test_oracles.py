"""Every query with SQL against DuckDB on the smallest tables: columns and rows, as multisets."""

import math
from collections import Counter

import duckdb
import pytest

from fathomline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
catalog.load()


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, sf, name):
    found = catalog.QUERIES[name](spark, sf)
    wanted = duck.sql(catalog.ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in columns]
    got = Counter(tuple(map(shown, r)) for r in found.select(*columns).collect())
    assert got == Counter(tuple(shown(r[i]) for i in at) for r in wanted.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
