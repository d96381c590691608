"""Every registered query of the engine against its SQL in DuckDB."""

import datetime
import math

import duckdb
import pytest

from entityspark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, float) and v == int(v):
        return int(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    cur = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted((tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in cur.fetchall()), key=str)


def test_plans(spark):
    """Filters and columns reach the scans, and small questions don't shuffle rows."""
    def plan(name):
        return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    p = plan("fk_navigation")
    assert "PushedFilters: [IsNotNull(o_totalprice)" in p and "GreaterThan(o_totalprice,1000.0)" in p and "o_orderdate" not in p
    assert "Exchange" not in plan("where_dnf") and "Exchange" not in plan("aabb")
    assert "CartesianProduct" not in plan("region_overlap") and "BroadcastNestedLoopJoin" not in plan("region_overlap")
    assert "TakeOrderedAndProject" in plan("most_common")
    assert plan("exact_scan").count("FileScan") == 1
