"""The registered queries against their SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from ferrule import oracle, steps
from ferrule import queries as engine

TABLES = "lineitem orders part supplier events"


def plain(v):
    return ("%.6f" % (v + 0.0)) if isinstance(v, float) and math.isfinite(v) else repr(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def test_every_query_has_its_sql_but_for_searches_and_listings():
    assert set(engine.queries()) - set(oracle.oracle_sql()) == {"search_front", "search_square_recovery"}
    assert set(steps.queries()) <= set(entry.queries()) & set(entry.oracle_sql())
    assert set(engine.queries()) <= set(entry.queries())


SOME = [n for n in engine.queries() if n in oracle.oracle_sql() and not (n.startswith("op_") and n not in ("op_log", "op_div", "op_sign")) and not (n.startswith("d_") and n not in ("d_pow", "d_clamp"))]
SOME += list(steps.queries())


@pytest.mark.parametrize("name", SOME)
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    sql = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    order = [df.columns.index(c) for c in sorted(df.columns)]
    other = [sql.columns.index(c) for c in sorted(sql.columns)]
    got = sorted([plain(r[i]) for i in order] for r in map(tuple, df.collect()))
    want = sorted([plain(r[i]) for i in other] for r in sql.fetchall())
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 1
