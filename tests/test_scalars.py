"""Scalar functions F1–F15 against the hand-worked values (FIXTURES X5, X6)."""

import math
from urllib.parse import urljoin

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ixpanel.functions import scalars as S
from ixpanel.operators import panel as P


def col1(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x")).alias("y")).collect()]


def test_clean_numeric(spark):
    cases = {"310.3": 310.3, "1,234.5": 1234.5, "12%": 12.0, "5 %": 5.0, "1e3": 1000.0,
             "+4": 4.0, ".5": 0.5, "5.": 5.0, "\t8 ": 8.0, "-": None, "N/A": None,
             "n/a": None, "nan": None, "": None, "--": None, "True": None, "1.0d": None,
             "2f": None, "0x1p3": None, "1_000": None, "٣": None}
    got = col1(spark, list(cases), S.clean_numeric)
    assert got == list(cases.values())
    assert col1(spark, ["inf"], S.clean_numeric) == [math.inf]


def test_is_numeric_no_comma_removal(spark):
    df = spark.createDataFrame([("1,234", "s"), ("12", "s"), ("nan", "s"), ("True", "b"),
                                ("2024-01-01 00:00:00", "d"), ("3", "n")], "raw string, kind string")
    got = [r[0] for r in df.select(S.is_numeric("raw", "kind")).collect()]
    assert got == [False, True, True, True, False, True]


def test_month_from_text(spark):
    cases = {"Dec to Jan": 1, "summary": 3, "Sept. 2024": 9, "Mayor": 5, "Annual": None}
    assert col1(spark, list(cases), S.month_from_text) == list(cases.values())


def test_month_shift(spark):
    vals = ["2025-06", "2025-6", "2025-01", "2025-13", "25-06", "2025-006", "2025-06-01", " 2025-06"]
    cur = col1(spark, vals, S.current_month)
    prev = col1(spark, vals, S.previous_month)
    assert cur[:3] == ["2025-06", "2025-06", "2025-01"]
    assert prev[:3] == ["2025-05", "2025-05", "2024-12"]
    assert cur[3:] == [None] * 5 and prev[3:] == [None] * 5


def test_date_from_text(spark):
    cases = {"CPI-U cpi-u-202506.xlsx": "2025-06", "June 2025 x.xlsx": "2025-06",
             "as of 2024 cpi-u-202506.xlsx": "2025-06", "table 2025-07.xlsx": "2025-07",
             "cpi-u-202599.xlsx": "2025-99", "CPI-U latest.xlsx": "2025-07"}
    got = col1(spark, list(cases), lambda c: S.date_from_text(c, F.lit("2025-07")))
    assert got == list(cases.values())


def test_seasonal_flag(spark):
    assert col1(spark, ["CUUR0000SA0", "ABCNSA1", None, "", "x"], S.seasonal_flag) == \
        [True, False, True, True, True]


URL_CASES = [
    ("https://site.example/cpi/tables/", "/files/a.xlsx"),
    ("https://site.example/cpi/tables/", "rel/b.xlsx"),
    ("https://site.example/cpi/tables/", "../up.xlsx"),
    ("https://site.example/cpi/tables/", "../../../x.xlsx"),
    ("https://site.example/cpi/tables/page.html", "./c.xlsx?x=1#f"),
    ("https://site.example/cpi/tables/", "//cdn.example/d.xlsx"),
    ("http://h.example:8080/a/b?q=1", "/c/./d/../e.xlsx"),
    ("http://h.example/a/b", "https://other.example/z.xls"),
    ("http://h.example/a/b?q=1#t", "#frag"),
    ("http://h.example/a/b?q=1#t", "?p=2"),
    ("http://h.example/a/b", ""),
    ("http://h.example", "x.xlsx"),
    ("http://h.example/a//b/", "c//d.xlsx"),
    ("http://h.example/a/b/", "mailto:someone@example.org"),
]


def test_url_resolve_matches_urljoin(spark):
    df = spark.createDataFrame(URL_CASES, "b string, h string")
    got = [r[0] for r in df.select(S.url_resolve("b", "h")).collect()]
    assert got == [urljoin(b, h) for b, h in URL_CASES]


def test_url_filename(spark):
    urls = ["https://a.example/x/y/cpi-u-202506.xlsx?dl=1#top", "https://a.example/", "http://a.example"]
    assert col1(spark, urls, S.url_filename) == ["cpi-u-202506.xlsx", "", ""]


def test_four_digit_year(spark):
    assert col1(spark, ["2024", "2019", "2031", "2024.0", "20245", "2030"], S.four_digit_year) == \
        [2024, None, None, None, None, 2030]


def test_link_priority(spark):
    rows = [("/x/cpi-u-202506.xlsx", "CPI-U"), ("/x/c-cpi-u-202506.xlsx", "C-CPI-U"),
            ("/files/latest.xlsx", " CPI-U "), ("https://o.example/cpi/u.xls", "June 2024"),
            ("/files/notes.pdf", "CPI-U"), ("/files/ppi-202506.xlsx", "PPI")]
    df = spark.createDataFrame(rows, "h string, t string")
    assert [r[0] for r in df.select(S.link_priority("h", "t")).collect()] == [1, 1, 2, 3, None, None]


def test_category_list(spark):
    vals = ["All items, Food,,Nope", " , ", " a ,b ,, c\t", "", "x"]
    got = col1(spark, vals, S.category_list)
    assert got == [[c.strip() for c in s.split(",") if c.strip()] for s in vals]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=" ,ab\t x", max_size=12), min_size=1, max_size=5))
def test_category_list_property(spark, values):
    got = col1(spark, values, S.category_list)
    assert got == [[c.strip() for c in s.split(",") if c.strip()] for s in values]


@pytest.mark.parametrize("text,want", [
    ("2024", (2024, 1)), ("20240101", (2024, 1)), ("Jan. 2024", (2024, 1)), ("1/15/2024", (2024, 1)),
    ("2024/01", (2024, 1)), ("2024/1/5", (2024, 1)), ("15 Jan 2024", (2024, 1)), ("2024Q1", (2024, 1)),
    ("2024q3", (2024, 7)), ("1Q2024", (2024, 1)), ("2024 Jan", (2024, 1)), ("January 15, 2024", (2024, 1)),
    ("Jan 15 2024", (2024, 1)), ("Sept. 2024", (2024, 9)), ("01/2024", (2024, 1)), ("2024.01", (2024, 1)),
    ("13/1/2024", (2024, 1)), ("3/4/2024", (2024, 3)), ("2024 January 5", (2024, 1)), ("June, 2024", (2024, 6)),
    ("  2024 ", (2024, 1)), ("May2024", (2024, 5)), ("Jun 2024", (2024, 6)), ("2024-05", (2024, 5)),
    ("202401", None), ("Q2 2024", None), ("2024M03", None), ("2024/13", None), ("2024/01/32", None),
    ("20241301", None), ("99999", None), ("abc", None), ("", None), ("2024 Q4", None), ("24", None),
])
def test_general_period_text(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    p = df.select(S.parse_period(F.col("t"), F.lit("s")).alias("p")).first().p
    assert (None if p.year is None else (p.year, p.month)) == want


def test_period_label(spark):
    df = spark.createDataFrame([(2024, 3), (2025, 12)], "y int, m int")
    assert [r[0] for r in df.select(S.period_label("y", "m")).collect()] == ["2024-03", "2025-12"]


@pytest.mark.parametrize("x,want", [(0.285, 0.28), (0.575, 0.57), (0.125, 0.12), (0.375, 0.38),
                                    (-0.125, -0.12), (0.555, 0.56)])
def test_rounding_pins(spark, x, want):
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(P.round2(F.col("x"))).first()[0] == want


def test_pct_change_zero_and_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (2.0, None), (100.285, 100.0)],
                               "cur double, prev double")
    got = [r[0] for r in df.select(P.pct_change(F.col("cur"), F.col("prev"))).collect()]
    import numpy as np
    assert got[:3] == [None, None, None]
    assert got[3] == float(np.round((100.285 - 100.0) / 100.0 * 100, 2))
