"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from shelfmark.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(rows):
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    if name not in registry.oracle_sql():
        assert rows
        return
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert shown(rows) == shown([tuple(r[i] for i in at) for r in found.fetchall()])


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).collect()
