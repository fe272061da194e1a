"""Steps that run once a cell or once a request are compiled: no generator is left to be interpreted,
and no method is longer than the JVM compiles (8000 bytes)."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from ixpanel.operators import requests as RQ
from ixpanel.plans import views as V

from conftest import SF_SMALL


@pytest.fixture
def whole_plans(spark):
    """Plans as they run, without adaptive stages around them."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda df: df._jdf.queryExecution().executedPlan()
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_cells_are_dealt_out_in_compiled_code(spark, whole_plans):
    plan = whole_plans(V.points_cells(spark, SF_SMALL)).toString()
    cells = [line for line in plan.splitlines() if "Generate inline" in line]
    assert cells and all(re.search(r"\*\([0-9]+\) Generate inline", line) for line in cells)


def test_request_code_is_short_enough_to_be_compiled(spark, whole_plans):
    routed = RQ.route_by_date(RQ.explode_valid(RQ.validate(V.requests(spark, SF_SMALL))))
    known = routed.filter(~F.regexp_extract("file", r"^cpi-u-([0-9]{6})\.xlsx$", 1).isin("", "199801"))
    code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package").codegenString(whole_plans(known))
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:([0-9]+)", code)) < 8000


def test_valid_requests_only(spark):
    rows = [(1, " a ,b,,a", "2025-3"), (2, "a", "2025-13"), (3, " , ", "2025-01"), (4, None, "2025-01"), (5, "a", None),
            (6, "c", "2025-01")]
    asked = RQ.explode_valid(RQ.validate(spark.createDataFrame(rows, "request_id int, categories string, date string")))
    assert asked.columns == ["request_id", "date", "ord", "ticker", "current_month", "previous_month"]
    assert sorted(map(tuple, asked.collect())) == [
        (1, "2025-3", 0, "a", "2025-03", "2025-02"), (1, "2025-3", 1, "b", "2025-03", "2025-02"),
        (1, "2025-3", 2, "a", "2025-03", "2025-02"), (6, "2025-01", 0, "c", "2025-01", "2024-12")]


def test_workbooks_of_shipments_without_a_date(spark, tmp_path):
    """A shipment without a date belongs to no month; one without a supplier, to no workbook."""
    day = dt.datetime(1996, 2, 3)
    rows = [(5, day, 10.0), (5, day, 2.5), (5, None, 1.0), (6, None, 7.0), (None, day, 3.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double") \
        .write.parquet(str(tmp_path / "lineitem.parquet"))
    cells = V.points_cells(spark, str(tmp_path)).filter((F.col("kind") == "n") | F.col("raw").isin("1996-02", "12.50"))
    assert sorted(map(tuple, cells.drop("sheet_pos", "kind").collect())) == [
        ("supplier-5.xlsx", "grid", 3, 2, 2, "2016"), ("supplier-5.xlsx", "grid", 3, 2, 4, "2"),
        ("supplier-5.xlsx", "grid", 3, 2, 15, "2"), ("supplier-5.xlsx", "series", 4, 3, 1, "1996-02"),
        ("supplier-5.xlsx", "series", 4, 3, 2, "12.50")]
