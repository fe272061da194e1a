"""Plan checks and oracle parity on the smallest driver tables."""

import os
import sys
import tempfile

import duckdb
import pytest

import __spark_entry__ as E
from ixpanel.operators import grids as G

from conftest import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from oracle_check import TABLES, rows_of  # noqa: E402

from ixpanel.plans.catalog import QUERIES  # noqa: E402
from ixpanel.plans.oracle import SQL  # noqa: E402


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans(spark, name):
    """Every query: no product of tables, no cached table, and no rows dealt out by number
    (only the drop folder of the streams and the header regions are dealt out by a key)."""
    p = plan_text(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "InMemoryTableScan" not in p and "REPARTITION_BY_NUM" not in p


def test_no_fact_shuffle_before_the_partial_aggregate(spark):
    for name in ("mom_change", "panel_profile"):
        p = plan_text(E.queries()[name](spark, SF_SMALL))
        assert "REPARTITION" not in p
    assert "partial_sum" in plan_text(E.queries()["mom_change"](spark, SF_SMALL))


def test_nothing_stays_cached(spark):
    spark.catalog.clearCache()
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    for name in ("latest_points", "recent_periods", "source_status"):
        QUERIES[name](spark, SF_SMALL).count()
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


def test_window_is_partitioned(spark):
    p = plan_text(E.queries()["mom_change"](spark, SF_SMALL))
    assert "SinglePartition" not in p
    assert "hashpartitioning(category" in p


def test_cell_filters_reach_parquet_scan(spark):
    from ixpanel.plans import views as V
    path = os.path.join(tempfile.mkdtemp(prefix="cells-"), "cells")
    V.sheet_cells(spark, SF_SMALL).write.parquet(path)
    cells = spark.read.parquet(path)
    plan = plan_text(G.header_rows(cells))
    assert "PushedFilters: [IsNotNull(r_raw), LessThanOrEqual(r_raw,11)" in plan   # header + sub-header rows
    assert "ReadSchema: struct<file:string,sheet:string,r_raw:int,raw:string>" in plan


ORACLE_SAMPLE = ["mom_change", "sheet_records", "wide_record", "coverage", "union_layouts",
                 "recent_periods", "link_target", "link_rank", "numeric_quality", "source_status",
                 "listing_links", "scan_first_sheet"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_oracle_parity_sf0001(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]) == rows_of(dcols, res.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["category", "date", "index", "adjustment", "prev_index", "mom_change_pct"]
    assert df.count() > 0
