"""Every registered query equals its DuckDB SQL (rounded values, any row order) on the sf0.001
tables; none is without SQL."""

import duckdb
import pytest

from tessera.plans.registry import load_all
from tessera.sources.tables import TABLES
from tools.check_oracle import digest

from .conftest import SF001

REG = load_all()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(n for n, q in REG.items() if q.sql is not None))
def test_query_matches_oracle(spark, duck, name):
    q = REG[name]
    df = q.fn(spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(q.oracle())
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_every_query_has_sql():
    assert [n for n, q in REG.items() if q.sql is None] == []


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() == 3 and set(df.columns) >= {"split", "auc"}
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["st6_inactivity_sessions", "a2_run_summary"])
def test_results_independent_of_session_time_zone(spark, duck, name):
    """Event times are stored wall clocks: results must not move with the session zone."""
    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = REG[name].fn(spark, SF001)
        rows = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
    res = duck.execute(REG[name].oracle())
    ocols = [d[0] for d in res.description]
    assert digest(df.columns, rows)[0] == digest(ocols, res.fetchall())[0]
