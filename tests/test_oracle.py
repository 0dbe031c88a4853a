"""Every registered query against its DuckDB SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import as_rows
from sitebag.plans.bindings import TABLES

SF = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, con):
    df = QUERIES[name](spark, SF)
    mine, columns = as_rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert mine
        return
    cur = con.execute(ORACLES[name])
    theirs, wanted = as_rows([d[0] for d in cur.description], cur.fetchall())
    assert columns == wanted
    assert mine == theirs


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
