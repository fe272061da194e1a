"""Grid layout operators (G1–G8) on the long cell table.

Cell table: ``file, sheet, sheet_pos, r_raw, r, c, raw, kind`` — one row per
non-blank cell; ``r_raw`` is the row as stored, ``r`` the row after all-blank
rows are dropped; ``kind`` ∈ {s, n, b, d}.

Every "search" of the original per-sheet loops is a grouped aggregate keyed by
``(file, sheet)`` (plus ``c`` or ``r``) followed by equi-joins on those keys;
no step compares all cells with all cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S

KEY = ["file", "sheet"]
ROLES = ["nsa_previous", "nsa_current", "sa_previous", "sa_current"]

POINT_COLS = ["file", "sheet", "layout", "r", "c", "ticker", "year", "month", "value",
              "series_id", "category", "source", "seasonally_adjusted"]


# ---------------------------------------------------------------- sources on cells

def first_sheet(cells: DataFrame, fold_na: bool = True) -> DataFrame:
    """The first sheet of every workbook; text cells equal to one of the
    reader's missing-value strings become blank (they are dropped)."""
    c = cells.filter(F.col("sheet_pos") == 0)
    if fold_na:
        c = c.filter(~((F.col("kind") == "s") & F.col("raw").isin(fixed.SHEET_NA_STRINGS)))
    return c


# ---------------------------------------------------------------- G1–G3

def header_pairs(cells: DataFrame, fill_merged: bool = False) -> DataFrame:
    """G1 + the text of the header row and the row below it, per column.

    Output ``file, sheet, header_r, c, h, s``. The header row is the first
    row 0…10 with a cell starting with ``expenditure category``. Only rows
    0…11 are read (pushed to the scan), a region bounded by the sheet width,
    so it is partitioned once by sheet and every later step (windows,
    per-column and per-sheet aggregates) reuses that partitioning.
    """
    w_sheet = Window.partitionBy(*KEY)
    starts = S.header_norm(F.col("raw"), strip=True).startswith(fixed.CATEGORY_HEADER)
    reg = (cells.filter(F.col("r_raw") <= fixed.HEADER_SEARCH_LAST_ROW + 1)
           .select(*KEY, "r_raw", "c", "raw")
           .repartition(*KEY)
           .withColumn("header_r", F.min(F.when((F.col("r_raw") <= fixed.HEADER_SEARCH_LAST_ROW) & starts,
                                                F.col("r_raw"))).over(w_sheet))
           .filter(F.col("header_r").isNotNull()
                   & ((F.col("r_raw") == F.col("header_r")) | (F.col("r_raw") == F.col("header_r") + 1))))
    pairs = reg.groupBy(*KEY, "header_r", "c").agg(
        F.max(F.when(F.col("r_raw") == F.col("header_r"), S.header_norm(F.col("raw")))).alias("h"),
        F.max(F.when(F.col("r_raw") == F.col("header_r") + 1, S.header_norm(F.col("raw")))).alias("s"))
    if fill_merged:
        # a merged header labels only its first column; carry it to the right
        w = Window.partitionBy(*KEY).orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
        pairs = pairs.withColumn("h", F.last("h", ignorenulls=True).over(w))
    return pairs


def unmerge(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """The cells, with the text of a merged header cell in every column of its range.

    ``ranges``: ``file, sheet, r_raw, c_first, c_last``. Only the first column
    of a range is stored; each range in the header region is joined with that
    cell by its place, and makes its other cells, which are blank in the table.
    """
    near = ranges.filter((F.col("r_raw") <= fixed.HEADER_SEARCH_LAST_ROW + 1) & (F.col("c_last") > F.col("c_first")))
    made = (cells.filter(F.col("r_raw") <= fixed.HEADER_SEARCH_LAST_ROW + 1)
            .join(near.withColumnRenamed("c_first", "c"), [*KEY, "r_raw", "c"])
            .withColumn("c", F.explode(F.sequence(F.col("c") + 1, F.col("c_last")))))
    return cells.unionByName(made.select(cells.columns))


def header_rows(cells: DataFrame) -> DataFrame:
    """G1: first row 0…10 with a cell starting with ``expenditure category``."""
    return header_pairs(cells).select(*KEY, "header_r").distinct()


def category_column(cells: DataFrame) -> DataFrame:
    """Last header-row column whose text contains ``expenditure category``."""
    return (header_pairs(cells).filter(F.col("h").contains(fixed.CATEGORY_HEADER))
            .groupBy(*KEY).agg(F.max("c").alias("cat_c")))


def _column_map(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    t = targets.withColumn("previous_month", S.previous_month(F.col("current_month")))
    ca, cy = S.month_label_parts(F.col("current_month"))
    pa, py = S.month_label_parts(F.col("previous_month"))
    j = pairs.join(t, KEY)
    h = F.coalesce(F.col("h"), F.lit("nan"))
    s = F.coalesce(F.col("s"), F.lit("nan"))
    cur_ok = s.contains(ca) & s.contains(cy)
    prev_ok = s.contains(pa) & s.contains(py)
    role = (F.when(h.contains(fixed.CATEGORY_HEADER), F.lit(None))
            .when(h.contains(fixed.NSA_HEADER),
                  F.when(cur_ok, F.lit("nsa_current")).when(prev_ok, F.lit("nsa_previous")))
            .when(h.contains(fixed.SA_HEADER),
                  F.when(cur_ok, F.lit("sa_current")).when(prev_ok, F.lit("sa_previous"))))
    j = j.withColumn("role", role)
    return j.groupBy(*KEY, "current_month").agg(
        *[F.max(F.when(F.col("role") == r, F.col("c"))).alias(f"c_{r}") for r in ROLES],
        F.max(F.when(h.contains(fixed.CATEGORY_HEADER), F.col("c"))).alias("cat_c"))


def column_map(cells: DataFrame, targets: DataFrame, fill_merged: bool = False) -> DataFrame:
    """Column of each (adjustment, month) role for every target month.

    ``targets``: ``file, sheet, current_month`` (``YYYY-MM``). Output: one
    row per target with ``c_<role>`` (null when unmapped). Unadjusted is
    tested before seasonally adjusted; the current month before the previous;
    among several matching columns the last one wins.
    """
    return _column_map(header_pairs(cells, fill_merged), targets).drop("cat_c")


def category_first_rows(cells: DataFrame, catc: DataFrame) -> DataFrame:
    """R1 index: first data row (from row 6) of every stripped label in the
    category column — one aggregate instead of a scan per requested name."""
    return (cells.join(catc, KEY)
            .filter((F.col("c") == F.col("cat_c")) & (F.col("r_raw") >= fixed.DATA_START_ROW))
            .select(*KEY, S.ustrip(F.col("raw")).alias("label"), "r_raw")
            .groupBy(*KEY, "label").agg(F.min("r_raw").alias("r_raw")))


def sheet_records(cells: DataFrame, targets_by_file: DataFrame,
                  fill_merged: bool = False) -> DataFrame:
    """G1–G3 + R1 index + R2/R3 for whole sheets: one record per
    first-occurring label of the category column, for each target month.

    ``targets_by_file``: ``file, current_month``. Plan: header facts from the
    bounded header region; one join of the data cells with the small
    per-target role map (category column + mapped month columns); one
    aggregation per data row, one per label, which keeps its first row. The
    SA fallback is column-level: no SA column → the NSA value.
    """
    c1 = first_sheet(cells)
    pairs = header_pairs(c1, fill_merged)
    sheets = pairs.select(*KEY).distinct()
    targets = targets_by_file.join(sheets, "file")
    cmap = _column_map(pairs, targets)
    mapped = F.struct(*[F.col(f"c_{r}").isNotNull().alias(r) for r in ROLES]).alias("mapped")
    roles = cmap.select(*KEY, "current_month", mapped, F.inline(F.array(
        F.struct(F.lit("label").alias("role"), F.col("cat_c").alias("c")),
        *[F.struct(F.lit(r).alias("role"), F.col(f"c_{r}").alias("c")) for r in ROLES]))) \
        .filter(F.col("c").isNotNull())
    data = c1.filter(F.col("r_raw") >= fixed.DATA_START_ROW).select(*KEY, "r_raw", "c", "raw") \
             .join(roles, KEY + ["c"])
    per_row = data.groupBy(*KEY, "current_month", "r_raw").agg(
        F.max(F.when(F.col("role") == "label", S.ustrip(F.col("raw")))).alias("label"),
        F.any_value("mapped").alias("mapped"),
        *[F.max(F.when(F.col("role") == r, S.clean_numeric(F.col("raw")))).alias(f"v_{r}") for r in ROLES])
    values = F.struct("mapped", *[f"v_{r}" for r in ROLES])
    rec = (per_row.filter(F.col("label").isNotNull()).groupBy(*KEY, "current_month", "label")
           .agg(F.min("r_raw").alias("r_raw"), F.min_by(values, "r_raw").alias("v")))
    nsa = {m: F.when(F.col(f"v.mapped.nsa_{m}"), F.col(f"v.v_nsa_{m}")) for m in ("previous", "current")}
    sa = {m: F.when(F.col(f"v.mapped.sa_{m}"), F.col(f"v.v_sa_{m}")).otherwise(nsa[m]) for m in nsa}
    return rec.select(
        *KEY, "current_month", "label", "r_raw",
        nsa["previous"].alias("nsa_previous"), nsa["current"].alias("nsa_current"),
        sa["previous"].alias("sa_previous"), sa["current"].alias("sa_current"),
        F.col("v.mapped.nsa_previous").alias("nsa_previous_mapped"),
        F.col("v.mapped.nsa_current").alias("nsa_current_mapped"))


def category_catalogue(cells: DataFrame, n: int | None = None) -> DataFrame:
    """Non-blank stripped labels of column 1 from row 6 on, per first
    sheet, in row order. ``n`` limits the rows scanned (blanks count), as the
    service's listing does; by default all rows are."""
    c1 = first_sheet(cells)
    lab = S.ustrip(F.col("raw"))
    rows = F.col("r_raw") >= fixed.DATA_START_ROW
    if n is not None:
        rows = rows & (F.col("r_raw") < fixed.DATA_START_ROW + n)
    return (c1.filter((F.col("c") == fixed.CATALOGUE_COLUMN) & rows)
            .filter(lab != "")
            .select(*KEY, "r_raw", lab.alias("category")))


# ---------------------------------------------------------------- G4–G8

POINT = ("layout", "c", "year", "month", "value", "series_id", "seasonally_adjusted")    # of a row's points
LAYOUTS = ("year_month", "timeseries", "context")


def _has_any(t: Column, words: list[str]) -> Column:
    e = F.lit(False)
    for w in words:
        e = e | t.contains(w)
    return e


def _month_of_prefix(t: Column) -> Column:
    """F3 of the first three letters of lower-case text: these are an abbreviation or no month."""
    abbr = F.create_map(*[F.lit(x) for i, a in enumerate(fixed.MONTH_ABBR, start=1) for x in (a, i)])
    return F.try_element_at(abbr, F.substring(t, 1, 3))


def layout_facts(cells: DataFrame) -> DataFrame:
    """What the three layouts need to know of each sheet, one row a sheet:

    ``hr4, year_c, months`` — G4's header row, year column and month of each
    column; ``hr5, d_c, v_c, s_c`` — G5's header row and role columns;
    ``col_month, col_year`` — G6's month and year of each column. Only rows
    0…10 and four-digit cells are read. They are dealt by sheet once; the
    lists are bounded by a sheet's width (times 11 rows).

    G4: candidate rows contain ``year`` or a four-digit cell; roles accumulate
    over them until a year column and a month column are known. G5: date
    words, else value words, else series words; roles accumulate until date
    and value are known. In both the last match wins.
    """
    t, r, c = F.lower(F.col("raw")), F.col("r"), F.col("c")
    is4 = F.col("raw").rlike(r"^[0-9]{4}$")
    near = F.col("r") <= fixed.HEADER_SEARCH_LAST_ROW
    role = F.when(r >= fixed.SERIES_HEADER_ROWS, F.lit(None)) \
            .when(_has_any(t, fixed.DATE_WORDS), "d").when(_has_any(t, fixed.VALUE_WORDS), "v") \
            .when(_has_any(t, fixed.SERIES_WORDS), "s")
    columns = (cells.filter(near | is4)
               .select(*KEY, "r", "c", S.four_digit_year(F.col("raw")).alias("yr4"), F.when(near, F.struct(
                   r.alias("r"), c.alias("c"), t.contains("year").alias("is_year"), is4.alias("is4"),
                   role.alias("role"), S.month_from_text(t).alias("mon"), _month_of_prefix(t).alias("mon3"))).alias("top"))
               .repartition(*KEY)
               .groupBy(*KEY, "c").agg(F.collect_list("top").alias("top"),
                                       F.min_by("yr4", F.when(F.col("yr4").isNotNull(), r)).alias("year")))
    sheets = columns.groupBy(*KEY).agg(F.collect_list(F.struct("c", "top", "year")).alias("cols")) \
                    .withColumn("top", F.flatten(F.transform("cols", lambda x: x["top"])))

    def rows(cond):
        return F.transform(F.filter("top", cond), lambda x: x["r"])

    def last_c(cond):       # the last column, of the last row up to the header row
        return F.array_max(F.transform(F.filter("top", cond), lambda x: F.struct(x["r"], x["c"])))["c"]

    def by_column(value):
        got = F.transform("cols", lambda x: F.struct(x["c"].alias("c"), value(x).alias("v")))
        return F.map_from_entries(F.filter(got, lambda x: x["v"].isNotNull()))

    def month(x):
        return ~x["is_year"] & x["mon"].isNotNull() & x["mon3"].isNotNull() & F.array_contains("cand", x["r"])

    def plays(role, up_to=None):
        return lambda x: (x["role"] == role) & (x["r"] <= up_to) if up_to is not None else x["role"] == role

    first = {k: F.array_min(rows(plays(k))) for k in "dv"}
    sheets = sheets.withColumn("cand", F.array_distinct(rows(lambda x: x["is_year"] | x["is4"])))
    sheets = sheets.select(
        *KEY, "cols", "top", "cand",
        # greatest() skips a null, + doesn't: both must be known
        F.when((F.array_min(rows(lambda x: x["is_year"])) + F.array_min(rows(month))).isNotNull(),
               F.greatest(F.array_min(rows(lambda x: x["is_year"])), F.array_min(rows(month)))).alias("hr4"),
        F.when((first["d"] + first["v"]).isNotNull(), F.greatest(first["d"], first["v"])).alias("hr5"))
    return sheets.select(
        *KEY, "hr4", "hr5",
        last_c(lambda x: x["is_year"] & (x["r"] <= F.col("hr4"))).alias("year_c"),
        by_column(lambda x: F.array_max(F.transform(
            F.filter(x["top"], lambda y: month(y) & (y["r"] <= F.col("hr4"))),
            lambda y: F.struct(y["r"], y["mon3"])))["mon3"]).alias("months"),
        *[last_c(plays(k, F.col("hr5"))).alias(f"{k}_c") for k in "dvs"],
        by_column(lambda x: F.array_min(F.transform(
            F.filter(x["top"], lambda y: y["mon"].isNotNull() & (y["r"] < fixed.CONTEXT_MONTH_ROWS)),
            lambda y: F.struct(y["r"], y["mon"])))["mon"]).alias("col_month"),
        by_column(lambda x: x["year"]).alias("col_year"))


def _sheet_rows(cells: DataFrame) -> DataFrame:
    """One row per sheet row, from one pass over the cells: the row's year for G4 and for G6, G5's
    cells, and the numeric cells with what their columns say (bounded by the sheet's width)."""
    raw, kind, r, c = (F.col(x) for x in ("raw", "kind", "r", "c"))
    zero = (kind == "n") & (raw.cast("decimal(38,0)") == 0)
    year4 = F.when((r > F.col("hr4")) & (c == F.col("year_c")) & raw.rlike(r"^[0-9]+$") & ~zero, raw.try_cast("int"))

    def below(column, value):
        return F.when((r > F.col("hr5")) & (c == F.col(column)), value)

    cell = cells.join(layout_facts(cells), KEY).withColumn("number", S.python_float(raw))     # read once a cell
    cell = cell.select(
        *KEY, "r", "c", "v_c", "s_c", S.is_numeric(raw, kind, F.col("number")).alias("num_ok"),
        S.numeric_value(raw, kind, F.col("number")).alias("num"),
        year4.alias("year4"), S.four_digit_year(raw).alias("yr4"),
        below("d_c", raw).alias("date_raw"), below("d_c", kind).alias("date_kind"),
        below("v_c", F.lit(True)).alias("is_v"), below("s_c", raw).alias("series_raw"),
        F.when(r > F.col("hr4"), F.try_element_at("months", c)).alias("month4"),
        F.try_element_at("col_month", c).alias("month6"), F.try_element_at("col_year", c).alias("col_year"))
    value = F.when(F.col("is_v") & F.col("num_ok"), F.struct(F.col("num").alias("num")))
    return cell.groupBy(*KEY, "r").agg(
        F.max("year4").alias("year4"), F.min_by("yr4", F.when(F.col("yr4").isNotNull(), c)).alias("row_year"),
        F.max("date_raw").alias("date_raw"), F.max("date_kind").alias("date_kind"), F.max(value).alias("value"),
        F.max("series_raw").alias("series_raw"), F.max("v_c").alias("v_c"), F.max("s_c").alias("s_c"),
        F.collect_list(F.when(F.col("num_ok"), F.struct(
            "c", "num", "month4", "month6", "col_year"))).alias("nums"))


def union_layouts(cells: DataFrame, ticker: str = "cpi", dedup: bool = False, layouts=LAYOUTS) -> DataFrame:
    """G4 ∪ G5 ∪ G6 as UNION ALL (a cell found by two layouts appears
    twice, as in the original), from one pass over the cells. ``dedup=True``
    keeps one row per cell and period instead."""
    def point(layout, c, year, month, value, series_id, sa):
        return F.struct(*(x.alias(n) for n, x in zip(POINT, (
            F.lit(layout), c, year.cast("int"), month.cast("int"), value.cast("double"), series_id, sa))))

    label, p = S.series_label(F.lit(ticker)), F.col("p")
    rows = _sheet_rows(cells)
    found = []
    if "year_month" in layouts:
        found.append(F.transform(
            F.filter("nums", lambda x: x["month4"].isNotNull() & F.col("year4").isNotNull()),
            lambda x: point("year_month", x["c"], F.col("year4"), x["month4"], x["num"], label, F.lit(True))))
    if "timeseries" in layouts:
        # No series column: no text; a blank series cell: the default label, and its flag.
        sid = F.when(F.col("s_c").isNull(), F.lit("")).otherwise(F.coalesce("series_raw", label))
        sa = S.seasonal_flag(F.when(F.col("s_c").isNull(), F.lit("")).otherwise(F.col("series_raw")))
        rows = rows.withColumn("p", F.when(F.col("date_raw").isNotNull() & F.col("value").isNotNull(),
                                           S.parse_period(F.col("date_raw"), F.col("date_kind"))))
        found.append(F.filter(F.array(point("timeseries", F.col("v_c"), p["year"], p["month"], F.col("value.num"), sid, sa)),
                              lambda x: (F.coalesce(x["year"], F.lit(0)) != 0) & (F.coalesce(x["month"], F.lit(0)) != 0)))
    if "context" in layouts:
        year = lambda x: F.coalesce("row_year", x["col_year"])
        found.append(F.transform(
            F.filter("nums", lambda x: x["month6"].isNotNull() & year(x).isNotNull()),
            lambda x: point("context", x["c"], year(x), x["month6"], x["num"], label, F.lit(True))))
    out = rows.select(*KEY, "r", F.inline(F.concat(*found) if len(found) > 1 else found[0])).withColumns({
        "ticker": F.lit(ticker), "category": F.lit(fixed.POINT_CATEGORY), "source": F.lit(fixed.POINT_SOURCE)}).select(POINT_COLS)
    if dedup:
        out = out.dropDuplicates(["file", "sheet", "r", "c", "year", "month"])
    return out


def year_month_unpivot(cells: DataFrame, ticker: str = "cpi") -> DataFrame:
    """``Year | Jan … Dec`` tables → points. Data rows are all rows after the header; the year
    must be all digits."""
    return union_layouts(cells, ticker, layouts=("year_month",))


def timeseries_extract(cells: DataFrame, ticker: str = "cpi") -> DataFrame:
    """``Date | Value | Series`` tables → points: every row after the header with a date, a
    numeric value and a period."""
    return union_layouts(cells, ticker, layouts=("timeseries",))


def context_extract(cells: DataFrame, ticker: str = "cpi") -> DataFrame:
    """Numeric cells with a year and a month from their context."""
    return union_layouts(cells, ticker, layouts=("context",))


def year_month_context(cells: DataFrame) -> DataFrame:
    """For every numeric cell, the year of its row (leftmost four-digit cell in 2020…2030), else
    of its column (topmost), and the month of its column (first month text in rows 0…4)."""
    return (_sheet_rows(cells).select(*KEY, "r", "row_year", F.inline("nums"))
            .select(*KEY, "r", "c", F.col("num").alias("value"),
                    F.coalesce("row_year", "col_year").alias("year"), F.col("month6").alias("month")))
