"""The three point layouts against a cell-by-cell reading of random sheets, and their plans."""

import random
import re

import pytest

from ixpanel.functions import fixed
from ixpanel.operators import grids as G
from ixpanel.operators import panel as P

from conftest import SF_SMALL, grid_cells


def month_in(text):
    return next((i for i, a in enumerate(fixed.MONTH_ABBR, 1) if a in text.lower()), None)


def number(v):
    try:
        return None if isinstance(v, str) and "_" in v else float(v)
    except ValueError:
        return None


def four(v):
    return int(str(v)) if re.fullmatch("[0-9]{4}", str(v)) else None


def recent(v):
    return four(v) if four(v) and 2020 <= four(v) <= 2030 else None


def year_month(grid):
    year_c, months = None, {}
    for r, row in enumerate(grid[:11]):
        if not any("year" in str(v).lower() or four(v) is not None for v in row if v is not None):
            continue
        for c, v in enumerate(row):
            if v is None:
                continue
            if "year" in str(v).lower():
                year_c = c
            elif month_in(str(v)) and month_in(str(v)[:3]):
                months[c] = month_in(str(v)[:3])
        if year_c is not None and months:
            break
    else:
        return
    for r2 in range(r + 1, len(grid)):
        row = grid[r2]
        y = row[year_c] if year_c < len(row) else None
        if y is None or not re.fullmatch("[0-9]+", str(y)) or y == 0:
            continue
        for c, m in months.items():
            if c < len(row) and row[c] is not None and number(row[c]) is not None:
                yield ("year_month", r2, c, int(str(y)), m, number(row[c]))


def time_series(grid):
    at = {}
    words = [("d", fixed.DATE_WORDS), ("v", fixed.VALUE_WORDS), ("s", fixed.SERIES_WORDS)]
    for r, row in enumerate(grid[:10]):
        for c, v in enumerate(row):
            role = next((k for k, ws in words if v is not None and any(w in str(v).lower() for w in ws)), None)
            if role:
                at[role] = c
        if "d" in at and "v" in at:
            break
    else:
        return
    for r2 in range(r + 1, len(grid)):
        row = grid[r2] + [None] * 9
        d, v = row[at["d"]], row[at["v"]]
        if d is None or v is None or number(v) is None:
            continue
        parts = str(d).split("-") if isinstance(d, str) else [1970, 1]        # numbers are nanoseconds
        if isinstance(d, str) and len(parts) == 1 and four(d):
            parts = [d, 1]                                                     # other rules: test_scalars
        if len(parts) > 1 and all(re.fullmatch("[0-9]+", str(p)) for p in parts[:2]) and int(parts[0]) and int(parts[1]):
            yield ("timeseries", r2, at["v"], int(parts[0]), int(parts[1]), number(v))


def context(grid):
    cell = lambda r, c: grid[r][c] if c < len(grid[r]) else None
    for r, row in enumerate(grid):
        for c, v in enumerate(row):
            if v is None or number(v) is None:
                continue
            year = next((recent(x) for x in row if x is not None and recent(x)), None)
            year = year or next((recent(cell(k, c)) for k in range(len(grid)) if cell(k, c) is not None and recent(cell(k, c))), None)
            month = next((month_in(str(cell(k, c))) for k in range(min(5, len(grid)))
                          if cell(k, c) is not None and month_in(str(cell(k, c)))), None)
            if year and month:
                yield ("context", r, c, year, month, number(v))


VALUES = [None, None, "Year", "Jan", "February", "1-Mar", "Summary", 2024, "2025", 2019, 2031, "Date", "Value", "Series ID",
          "2024-03", "2024-13", "x-1", 1.5, "7", "1,234", "-", "note", "Jan Year", 0, "Index date"]


def test_layouts_of_random_sheets(spark):
    rng = random.Random(4)
    grids = {}
    for k in range(60):
        width = rng.randint(1, 5)
        grid = [[rng.choice(VALUES) for _ in range(width)] for _ in range(rng.randint(1, 14))]
        if rng.random() < 0.6:
            grid.insert(rng.randint(0, min(11, len(grid))), rng.sample(["Year", "Jan", "Feb", "Date", "Value"], k=min(width, 5)))
        grid = [row for row in grid if any(v is not None for v in row)]
        if grid:
            grids[f"b{k}.xlsx"] = grid
    cells = None
    for file, grid in grids.items():
        one = grid_cells(spark, grid, file=file)
        cells = one if cells is None else cells.unionByName(one)
    cells = spark.createDataFrame(cells.collect(), cells.schema)
    got = sorted((p.file, p.layout, p.r, p.c, p.year, p.month, p.value) for p in G.union_layouts(cells).collect())
    want = sorted((f, *p) for f, g in grids.items() for kind in (year_month, time_series, context) for p in kind(g))
    assert [p for p in got if p not in want] == [] and [p for p in want if p not in got] == [] and len(got) == len(want)
    assert {p[1] for p in want} == {"year_month", "timeseries", "context"}
    for layout, f in (("year_month", G.year_month_unpivot), ("context", G.context_extract)):
        assert sorted((p.file, p.layout, p.r, p.c, p.year, p.month, p.value) for p in f(cells).collect()) == \
            [p for p in got if p[1] == layout]


def test_one_pass_over_the_cells(spark):
    from ixpanel.plans import views as V
    df = G.union_layouts(V.points_cells(spark, SF_SMALL))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", plan)) <= 6 and plan.count("FileScan") == 2
    recent = P.recent_periods(df, 2, by=["file"])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", recent)) <= 8 and "WindowGroupLimit" in recent


def test_unmerged_headers(spark, x1_rows):
    grid, rows = x1_rows
    grid = [list(r) for r in grid]
    grid[1][4] = grid[1][6] = None
    cells = grid_cells(spark, grid, file="f.xlsx", rows=rows)
    ranges = spark.createDataFrame([("f.xlsx", "Sheet1", 3, 3, 4), ("f.xlsx", "Sheet1", 3, 5, 6), ("f.xlsx", "Sheet1", 3, 1, 1),
                                    ("f.xlsx", "Sheet1", 40, 0, 9), ("g.xlsx", "Sheet1", 3, 0, 9)],
                                   "file string, sheet string, r_raw int, c_first int, c_last int")
    t = spark.createDataFrame([("f.xlsx", "Sheet1", "2025-06")], "file string, sheet string, current_month string")
    m = G.column_map(G.unmerge(cells, ranges), t).first()
    assert (m.c_nsa_previous, m.c_nsa_current, m.c_sa_previous, m.c_sa_current) == (3, 4, 5, 6)
    assert G.column_map(cells, t).first().c_nsa_current is None
    assert G.unmerge(cells, ranges).count() == cells.count() + 2


@pytest.mark.parametrize("n", [1, 3])
def test_top_per_group_keeps_few_rows_a_task(spark, n):
    from pyspark.sql import functions as F
    df = spark.range(1000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("g"), F.col("id").alias("v"))
    top = P.top_per_group(df, ["g"], [F.desc("v")], n)
    want = {}
    for i in range(999, -1, -1):
        want.setdefault(i % 7 * (i % 2), []).append(i)
    assert sorted((r.g, r.rank, r.v) for r in top.collect()) == sorted(
        (g, k + 1, v) for g, vs in want.items() for k, v in enumerate(vs[:n]))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert re.search("WindowGroupLimit.*Partial", plan)          # below the shuffle


def test_merged_profiles_equal_the_whole(spark):
    from pyspark.sql import functions as F
    rows = [(f"c{i % 13}", f"2024-{1 + i % 12:02d}", float(i), "nsa" if i % 3 else "sa", i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "category string, date string, index double, adjustment string, batch int")
    one = P.panel_profile(df).first()
    parts = [P.profile_partial(df.filter(F.col("batch") == b), "batch") for b in range(4)]
    a, s = parts[0]
    for x, y in parts[1:]:
        a, s = a.unionByName(x), s.unionByName(y)
    merged = P.merge_profiles(a, s).first()
    assert all(merged[c] == one[c] for c in one.asDict()) and merged.about_categories == 13
    empty = P.merge_profiles(*P.profile_partial(df.filter("false"), "batch")).first()
    assert (empty.n_rows, empty.n_categories, empty.first_date) == (0, 0, None)
