"""Grid operators on the hand-worked sheets of FIXTURES X1–X4."""

import pytest

from ixpanel.operators import grids as G
from ixpanel.operators import panel as P
from ixpanel.operators import requests as RQ

from conftest import grid_cells

FILE = "cpi-u-202506.xlsx"


def x1(spark, x1_rows, drop_cols=(), blank_headers=()):
    grid, rows = x1_rows
    g = [list(r) for r in grid]
    for c in blank_headers:
        g[1][c] = None
    g = [[None if c in drop_cols else v for c, v in enumerate(r)] for r in g]
    return grid_cells(spark, g, file=FILE, rows=rows)


def ask(spark, cells, names, date="2025-06", fill_merged=False):
    req = spark.createDataFrame([(1, names, date)], "request_id long, categories array<string>, date string")
    checked = RQ.validate(req, "post")
    routed = RQ.route_by_date(RQ.explode_valid(checked))
    looked_up = RQ.lookup(cells, routed, fill_merged)
    return looked_up, routed, RQ.found_records(looked_up)


def wide_rows(wide):
    return [tuple(r) for r in wide.orderBy("ord").select(
        "category", "nsa_previous", "nsa_current", "sa_previous", "sa_current").collect()]


def test_header_and_column_map(spark, x1_rows):
    cells = G.first_sheet(x1(spark, x1_rows))
    hdr = G.header_rows(cells)
    assert [tuple(r) for r in hdr.collect()] == [(FILE, "Sheet1", 3)]
    assert G.category_column(cells).first()["cat_c"] == 1
    t = spark.createDataFrame([(FILE, "Sheet1", "2025-06")], "file string, sheet string, current_month string")
    m = G.column_map(cells, t).first()
    assert (m.c_nsa_previous, m.c_nsa_current, m.c_sa_previous, m.c_sa_current) == (3, 4, 5, 6)


def test_x1_wide_long_change_coverage(spark, x1_rows):
    cells = x1(spark, x1_rows)
    looked_up, routed, wide = ask(spark, cells, ["Energy", "Food", "Nope", "All items"])
    assert wide_rows(wide) == [("Energy", 1275.4, 1280.1, None, 281.0),
                               ("Food", 338.0, 339.5, None, 339.9),
                               ("All items", 320.58, 321.465, 320.58, 321.5)]
    ch = P.mom_change_wide(wide).orderBy("ord").select("nsa_mom_change_pct", "sa_mom_change_pct").collect()
    assert [tuple(r) for r in ch] == [(0.37, None), (0.44, None), (0.28, 0.29)]
    long = P.long_format(wide)
    assert long.count() == 10
    cov = RQ.coverage(looked_up).first()
    assert (cov.requested, cov.found_wide, cov.failed_wide, cov.found_long, cov.failed_long) == (4, 3, 1, 3, 1)
    assert cov.message_wide == "Successfully loaded data for 3 categories"
    assert cov.message_long == "Successfully loaded data for 3 categoriesin long format"
    assert [r.ticker for r in RQ.missing_categories(looked_up).collect()] == ["Nope"]


def test_duplicate_request(spark, x1_rows):
    cells = x1(spark, x1_rows)
    looked_up, routed, wide = ask(spark, cells, ["Food", "Food"])
    long = P.long_format(wide)
    assert wide.count() == 2 and long.count() == 6
    cov = RQ.coverage(looked_up).first()
    assert (cov.failed_wide, cov.found_long, cov.failed_long) == (0, 1, 1)


def test_unknown_only(spark, x1_rows):
    cells = x1(spark, x1_rows)
    looked_up, routed, wide = ask(spark, cells, ["Nope"])
    cov = RQ.coverage(looked_up).first()
    assert not cov.success_wide
    assert cov.message_wide == "No data found for the specified categories and date 2025-06"


def test_catalogue(spark, x1_rows):
    cells = x1(spark, x1_rows)
    n4 = [r.category for r in G.category_catalogue(cells, 4).orderBy("r_raw").collect()]
    n5 = [r.category for r in G.category_catalogue(cells, 5).orderBy("r_raw").collect()]
    assert n4 == ["All items", "Food", "Energy"]
    assert n5 == ["All items", "Food", "Energy", "Food"]


def test_x2_no_sa_columns_falls_back(spark, x1_rows):
    cells = x1(spark, x1_rows, drop_cols=(5, 6))
    _, _, wide = ask(spark, cells, ["Energy", "Food", "All items"])
    for r in wide.collect():
        assert r.sa_previous == r.nsa_previous and r.sa_current == r.nsa_current
    assert P.long_format(wide).count() == 12


def test_x3_merged_headers(spark, x1_rows):
    cells = x1(spark, x1_rows, blank_headers=(4, 6))
    _, _, wide = ask(spark, cells, ["All items"])
    assert wide_rows(wide) == [("All items", 320.58, None, 320.58, None)]
    _, _, wide2 = ask(spark, cells, ["All items"], fill_merged=True)
    assert wide_rows(wide2) == [("All items", 320.58, 321.465, 320.58, 321.5)]


def test_one_month_answer_shape(spark, x1_rows):
    cells = x1(spark, x1_rows)
    _, _, wide = ask(spark, cells, ["All items"])
    assert P.wide_for_date(wide, "2025-06").columns == \
        ["category", "nsa_2025-05", "nsa_2025-06", "sa_2025-05", "sa_2025-06"]
    assert P.month_labelled(wide).columns[-4:] == \
        ["nsa_previous_month", "nsa_current_month", "sa_previous_month", "sa_current_month"]


# ---------------------------------------------------------------- X4

X4A = [["Consumer Price Index"],
       ["Year", "Jan", "Feb", "Annual"],
       [2024, 308.4, 310.3, 313.7],
       [2025, 317.7, "1,234", None],
       [2019, 251.7, 252.8, "-"]]
X4B = [["Date", "Value", "Series ID"],
       ["2024-01", 310.3, "CUUR0000SA0"],
       ["2024-02", "311.1", None],
       ["2024M03", 312.0, "X"],
       ["2024-04", "n.a.", "CUUR0000SA0"],
       ["2024-13", 1.0, "ABCNSA1"]]
X4C = [[None, "January 2025", "Feb 2025"],
       [2025, 317.7, 319.1],
       ["x", "5", None]]


def pts(df):
    return sorted((r.year, r.month, r.value) for r in df.collect())


def test_x4a_year_month(spark):
    cells = grid_cells(spark, X4A)
    assert pts(G.year_month_unpivot(cells)) == sorted(
        [(2024, 1, 308.4), (2024, 2, 310.3), (2025, 1, 317.7), (2019, 1, 251.7), (2019, 2, 252.8)])
    assert G.timeseries_extract(cells).count() == 0
    assert pts(G.context_extract(cells)) == [(2024, 1, 308.4), (2024, 2, 310.3), (2025, 1, 317.7)]
    u = G.union_layouts(cells)
    assert u.count() == 8
    rec = P.recent_periods(u, 2)
    assert sorted(r.value for r in rec.collect()) == [310.3, 310.3, 317.7, 317.7]
    # idempotent
    assert P.recent_periods(rec, 2).count() == 4


def test_x4b_time_series(spark):
    cells = grid_cells(spark, X4B)
    got = sorted((r.year, r.month, r.value, r.series_id, r.seasonally_adjusted)
                 for r in G.timeseries_extract(cells).collect())
    assert got == [(2024, 1, 310.3, "CUUR0000SA0", True), (2024, 2, 311.1, "CPI_U_CPI", True),
                   (2024, 13, 1.0, "ABCNSA1", False)]
    assert G.year_month_unpivot(cells).count() == 0 and G.context_extract(cells).count() == 0
    rec = P.recent_periods(G.union_layouts(cells), 2)
    assert sorted((r.year, r.month) for r in rec.collect()) == [(2024, 2), (2024, 13)]
    no_series = grid_cells(spark, [r[:2] for r in X4B])
    assert {r.series_id for r in G.timeseries_extract(no_series).collect()} == {""}


def test_x4c_context_only(spark):
    cells = grid_cells(spark, X4C)
    assert pts(G.context_extract(cells)) == [(2025, 1, 317.7), (2025, 2, 319.1)]
    assert G.year_month_unpivot(cells).count() == 0 and G.timeseries_extract(cells).count() == 0


def test_layout_stats(spark):
    cells = grid_cells(spark, X4A)
    st = {(r.layout, r.n_points) for r in P.layout_stats(G.union_layouts(cells)).collect()}
    assert st == {("year_month", 5), ("context", 3)}


@pytest.mark.parametrize("date,names,form,reason", [
    ("2025-06", ["All items", "Food", "Nope"], "get", None),
    ("2025-13", ["Food"], "get", "date must be YYYY-MM"),
    ("2025-06", [f"c{i}" for i in range(20)], "get", None),
    ("2025-06", [f"c{i}" for i in range(21)], "get", "maximum 20 categories"),
    ("2025-06", [f"c{i}" for i in range(200)], "post", None),
    ("2025-06", [f"c{i}" for i in range(201)], "post", "maximum 200 categories"),
    ("2025-06", [f"c{i}" for i in range(201)], "batch", None),
    ("2025-6", ["Food"], "get", None),
])
def test_x9_request_rules(spark, date, names, form, reason):
    req = spark.createDataFrame([(1, names, date)], "request_id long, categories array<string>, date string")
    assert RQ.validate(req, form).first().reason == reason


def test_x9_get_form(spark):
    req = spark.createDataFrame([(1, "All items, Food,,Nope", "2025-06"), (2, " , ", "2025-06")],
                                "request_id long, categories string, date string")
    rows = {r.request_id: r for r in RQ.validate(req).collect()}
    assert rows[1].category_list == ["All items", "Food", "Nope"] and rows[1].reason is None
    assert rows[2].reason == "at least one category must be specified"
    ex = RQ.explode_valid(RQ.validate(spark.createDataFrame(
        [(5, "Food", "2025-6")], "request_id long, categories string, date string"))).first()
    assert (ex.current_month, ex.previous_month) == ("2025-06", "2025-05")


def test_union_dedup_option(spark):
    cells = grid_cells(spark, X4A)
    assert G.union_layouts(cells).count() == 8            # UNION ALL keeps both layouts' copies
    assert G.union_layouts(cells, dedup=True).count() == 5
