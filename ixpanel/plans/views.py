"""Derived views over the driver tables.

The driver tables hold no workbooks, so the grid operators run on cell tables
that Spark renders from the tables themselves. Every view is a lazy DataFrame
whose size grows with its source tables; nothing is collected.

The ``sa`` measure of ``panel`` is a second stand-in series (quantity), not a
seasonal adjustment; the grid years are shown moved by +25 years so that the
2020–2030 year window of the context layout applies to them.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

DEC = "decimal(18,2)"
# --- fixed values of the renderers (documented in README) ---
SUPPLEMENTAL_SHEET = "Table 7"
YEAR_SHIFT = 25
PLACEHOLDERS = ["-", "N/A", "n/a", "nan"]
LISTING_BASE = "https://site.example/cpi/tables/"
MESSY_STYLES = 8


def _cell(file, sheet, sheet_pos, r_raw, r, c, raw, kind):
    return F.struct(
        file.alias("file"), sheet.alias("sheet"),
        F.lit(sheet_pos).cast("int").alias("sheet_pos") if isinstance(sheet_pos, int)
        else sheet_pos.cast("int").alias("sheet_pos"),
        F.lit(r_raw).cast("int").alias("r_raw") if isinstance(r_raw, int) else r_raw.cast("int").alias("r_raw"),
        F.lit(r).cast("int").alias("r") if isinstance(r, int) else r.cast("int").alias("r"),
        F.lit(c).cast("int").alias("c") if isinstance(c, int) else c.cast("int").alias("c"),
        raw.cast("string").alias("raw"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))


def _explode_cells(df: DataFrame, cells) -> DataFrame:
    """One output row per cell struct with a text, of the array (or list) ``cells``."""
    return df.select(F.inline(F.filter(F.array(*cells) if isinstance(cells, list) else cells,
                                       lambda x: x["raw"].isNotNull())))


# ---------------------------------------------------------------- panel

def _category():
    return F.concat_ws("/", "p_brand", F.col("p_size").cast("string"), "p_type")


def panel_wide(spark: SparkSession, d: str) -> DataFrame:
    """(category, date, nsa, sa) monthly sums per brand, size and type of part (at most
    25 x 50 x 6 categories, as many as the parts have), DECIMAL(18,2) sums."""
    li = read_table(spark, d, "lineitem").select("l_partkey", "l_shipdate",
                                                 "l_extendedprice", "l_quantity")
    pt = read_table(spark, d, "part").select("p_partkey", _category().alias("category"))
    j = li.join(pt, li.l_partkey == pt.p_partkey)
    return (j.groupBy("category",
                      F.date_format("l_shipdate", "yyyy-MM").alias("date"))
            .agg(F.sum(F.col("l_extendedprice").cast(DEC)).alias("nsa"),
                 F.sum(F.col("l_quantity").cast(DEC)).alias("sa")))


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Canonical long fact table ``(category, date, index, adjustment)``."""
    w = panel_wide(spark, d).select(
        "category", "date", F.col("nsa").cast("double").alias("nsa"),
        F.col("sa").cast("double").alias("sa"))
    return w.unpivot(["category", "date"], ["nsa", "sa"], "adjustment", "index") \
            .select("category", "date", "index", "adjustment")


# ---------------------------------------------------------------- sheets

def placeholder_rule(r_raw, c, month_ord):
    """Every 7th value cell of a rendered sheet is a placeholder token."""
    return ((r_raw * 3 + c + month_ord) % 7) == 0


def placeholder_token(r_raw, c):
    return F.element_at(F.array(*[F.lit(t) for t in PLACEHOLDERS]),
                        ((r_raw + c) % 4 + 1).cast("int"))


# Layouts of the supplemental sheets, dealt by month (year * 12 + month, modulo 8): header row, and
# what differs from the usual one.
SHEET_HEADERS = [3, 0, 10, 11, 3, 3, 3, 3]
HEADER_TOO_LOW, NO_SA, SHIFTED, SA_FIRST, MERGED = 3, 4, 5, 6, 7


def sheet_cells(spark: SparkSession, d: str) -> DataFrame:
    """``panel`` rendered as one supplemental-table workbook per month.

    The layout follows the month (``SHEET_HEADERS``): the header in row 3, 0
    or 10, or in row 11, where it isn't found; no adjusted columns; all
    columns one to the right; adjusted columns first; header texts of merged
    cells (``merged_ranges``), which only their first column has. A title in
    row 0 unless the header is there, months below the header, categories in
    name order from row 6 or three rows below the header; value cells are
    comma-grouped text, every 7th one a placeholder. Some rows are blank, so
    ``r_raw`` and ``r`` differ.
    """
    from pyspark.sql import Window
    by = Window.partitionBy("category").orderBy("date")         # bounded: months of a category
    month = F.to_date(F.col("date"), "yyyy-MM")
    follows = F.lag("date").over(by) == F.date_format(F.add_months(month, -1), "yyyy-MM")
    rows = panel_wide(spark, d).select(
        "category", "date", F.col("nsa").alias("nsa_cur"), F.col("sa").alias("sa_cur"),
        F.when(follows, F.lag("nsa").over(by)).alias("nsa_prev"),
        F.when(follows, F.lag("sa").over(by)).alias("sa_prev"))
    pmonth = F.add_months(month, -1)
    file, sheet = _month_file(month), F.lit(SUPPLEMENTAL_SHEET)
    # category row index per month: rank among the month's categories. A month
    # holds at most one row per category, bounded by the sheet size.
    i = F.row_number().over(Window.partitionBy("date").orderBy("category")) - 1
    rows = rows.withColumn("i", i).withColumn("mord", _month_number(month)) \
               .withColumn("v", F.col("mord") % 8).withColumn("h", _pick(SHEET_HEADERS, F.col("v")))
    v, h, mord = F.col("v"), F.col("h"), F.col("mord")
    below = F.when(h > 0, 1).otherwise(0)                        # the title is a row of its own
    r_raw = F.greatest(F.lit(6), h + 3) + F.col("i")
    r = below + 2 + F.col("i")
    shift = F.when(v == SHIFTED, 1).otherwise(0)
    nsa, sa = F.when(v == SA_FIRST, 5).otherwise(3) + shift, F.when(v == SA_FIRST, 3).otherwise(5) + shift

    def val(cname, c):
        txt = F.format_number(F.col(cname), 2)
        return F.when(F.col(cname).isNotNull(),
                      F.when(placeholder_rule(r_raw, c, mord), placeholder_token(r_raw, c)).otherwise(txt))

    first = F.col("i") == 0      # each sheet's header cells come with its first data row
    lab = lambda m: F.concat(F.date_format(m, "MMM"), F.lit(".\n"), F.date_format(m, "yyyy"))
    with_sa, single = v != NO_SA, v != MERGED

    def head(c, text, cond=F.lit(True)):
        return _cell(file, sheet, 0, h, below, c, F.when(first & cond, F.lit(text)), "s")

    def months(c, text, cond=F.lit(True)):
        return _cell(file, sheet, 0, h + 1, below + 1, c, F.when(first & cond, text), "s")

    cells = [
        _cell(file, sheet, 0, 0, 0, 0, F.when(
            first & (h > 0), F.concat(F.lit("Table 7. Index by kind of part, "), F.col("date"))), "s"),
        head(shift, "Indent level"), head(shift + 1, "Expenditure category"), head(shift + 2, "Relative importance"),
        head(nsa, "Unadjusted indexes"), head(nsa + 1, "Unadjusted indexes", single),
        head(sa, "Seasonally adjusted indexes", with_sa),
        head(sa + 1, "Seasonally adjusted indexes", with_sa & single),
        head(shift + 7, "Unadjusted percent change"),
        months(nsa, lab(pmonth)), months(nsa + 1, lab(month)),
        months(sa, lab(pmonth), with_sa), months(sa + 1, lab(month), with_sa),
        months(shift + 7, F.concat(lab(pmonth), F.lit("-\n"), lab(month))),
        _cell(file, sheet, 0, r_raw, r, shift, F.lit("1"), "n"),
        _cell(file, sheet, 0, r_raw, r, shift + 1, F.col("category"), "s"),
        _cell(file, sheet, 0, r_raw, r, nsa, val("nsa_prev", nsa), "s"),
        _cell(file, sheet, 0, r_raw, r, nsa + 1, val("nsa_cur", nsa + 1), "s"),
        _cell(file, sheet, 0, r_raw, r, sa, F.when(with_sa, val("sa_prev", sa)), "s"),
        _cell(file, sheet, 0, r_raw, r, sa + 1, F.when(with_sa, val("sa_cur", sa + 1)), "s"),
    ]
    return _explode_cells(rows, cells)


def _month_file(month):
    return F.concat(F.lit("cpi-u-"), F.date_format(month, "yyyyMM"), F.lit(".xlsx"))


def _month_number(month):
    return F.year(month) * 12 + F.month(month)


def _pick(values, at):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (at + 1).cast("int"))


def merged_ranges(spark: SparkSession, d: str) -> DataFrame:
    """``file, sheet, r_raw, c_first, c_last`` of the merged header cells of ``sheet_cells``."""
    month = F.to_date(F.date_format("l_shipdate", "yyyy-MM"), "yyyy-MM")
    months = read_table(spark, d, "lineitem").select(month.alias("m")).filter(F.col("m").isNotNull()).distinct()
    merged = months.filter(_month_number(F.col("m")) % 8 == MERGED)
    return merged.select(_month_file(F.col("m")).alias("file"), F.lit(SUPPLEMENTAL_SHEET).alias("sheet"),
                         F.lit(SHEET_HEADERS[MERGED]).alias("r_raw"),
                         F.explode(F.array(*[F.struct(F.lit(c).alias("c_first"), F.lit(c + 1).alias("c_last"))
                                             for c in (3, 5)])).alias("x")).select("file", "sheet", "r_raw", "x.*")


# ---------------------------------------------------------------- points workbooks

# Layouts of a supplier's workbook, dealt by supplier number.
GRID_HEADERS = [1, 11, 0, 10, 3]        # header row of the grid; in row 11 it isn't found
SERIES_HEADERS = [0, 2, 10, 9]          # of the series; in row 10 it isn't found
SERIES_COLUMNS = ([0, 2, 1], [1, 0, 2], [2, 1, 0])      # of date, value and series
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
               "November", "December"]


def _supplier_file(k):
    return F.concat(F.lit("supplier-"), k.cast("string"), F.lit(".xlsx"))


def _books(spark: SparkSession, d: str) -> DataFrame:
    """One row per supplier: number and value of its shipments by month (bounded by the calendar)."""
    li = read_table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice")
    monthly = li.groupBy(F.col("l_suppkey").alias("k"), F.trunc("l_shipdate", "month").alias("ms")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast(DEC)).alias("amount"))
    known = F.when(F.col("ms").isNotNull(), F.struct("ms", "n", "amount"))
    return monthly.groupBy("k").agg(F.sort_array(F.collect_list(known)).alias("months"))


def series_text_rule(k, month):
    """Series cell text: SA/NSA code by supplier, blank every 4th month."""
    code = F.concat(F.lit("SUP"), k.cast("string"), F.when(k % 3 == 1, F.lit("NSA")).otherwise(F.lit("SA")))
    return F.when(month % 4 != 0, code)


def date_text_rule(ms):
    m = F.month(ms)
    return (F.when(m == 3, F.concat(F.date_format(ms, "yyyy"), F.lit("M03")))
            .when(m % 6 == 0, F.date_format(ms, "MMM yyyy"))
            .when(m % 5 == 0, F.date_format(ms, "yyyy-MM-dd 00:00:00"))
            .otherwise(F.date_format(ms, "yyyy-MM")))


def points_cells(spark: SparkSession, d: str) -> DataFrame:
    """One workbook per supplier, two sheets.

    ``grid``: shipments as ``Year × Jan…Dec``. Years are shown later, so that
    some are in 2020…2030. By supplier: the header row (``GRID_HEADERS``;
    titles above it and a blank row after those), 0 to 2 blank columns first,
    short or long month names, years as numbers or text.

    ``series``: monthly value as ``Date, Value, Series`` rows. By supplier:
    the header row, the order and names of the columns, and for every 5th no
    series column. Every March is written in a way that names no period, May
    and October are dates, September has no value.
    """
    k, month = F.col("k"), "struct<ms: date, n: bigint, amount: decimal(28,2), i: int, grid_i: int>"
    head_cell, year = "struct<sheet: int, r_raw: int, r: int, c: int, raw: string>", "struct<i: int, y: int, n: bigint>"
    shapes = [F.lit(None).cast(t) for t in (head_cell, year, month)]
    books = _books(spark, d).filter(k.isNotNull()).select(
        "k", "months", F.array_sort(F.array_distinct(F.transform("months", lambda x: F.year(x["ms"])))).alias("years"),
        _pick(GRID_HEADERS, k % 5).alias("gh"), _pick(SERIES_HEADERS, k % 4).alias("sh"),
        (k % 3).cast("int").alias("o"), *[_pick(at, k % 3).alias(f"{c}_c") for c, at in zip("dvs", SERIES_COLUMNS)])
    o, has_series = F.col("o"), k % 5 != 0
    gap = {"gh": F.when(F.col("gh") > 0, 1).otherwise(0), "sh": F.when(F.col("sh") > 0, 1).otherwise(0)}
    word = lambda a, b: F.when(k % 2 == 0, F.lit(a)).otherwise(F.lit(b))

    def item(at, value):        # one of a header cell, a year of the grid, a month
        return F.struct(*[x.alias(n) for n, x in zip(("head", "year", "month"), [*shapes[:at], value, *shapes[at + 1:]])])

    def head(sheet, r_raw, r, c, raw):
        return item(0, F.struct(*[x.cast("int") for x in (F.lit(sheet), r_raw, r, c)], raw).cast(head_cell))

    def titles(sheet, h):
        return F.transform(F.sequence(F.lit(0), F.col(h)), lambda t: head(sheet, t, t, F.lit(0), F.when(
            t < F.col(h), F.when(t == 0, F.lit("Shipments by month")).otherwise(F.concat(F.lit("Note "), t.cast("string"))))))

    def row(sheet, h, cells):
        return F.array(*[head(sheet, F.col(h) + gap[h], F.col(h), c, raw) for c, raw in cells])

    # The header cells of a workbook are made once; its years and months are dealt out as they are, and
    # their few cells come from an array without lambdas, which Spark compiles.
    heads = F.concat(
        row(0, "gh", [(o, F.lit("Year")), (o + 13, F.lit("Annual")),
                      *[(o + j, word(t[:3], t)) for j, t in enumerate(MONTH_NAMES, 1)]]),
        row(1, "sh", [(F.col("d_c"), word("Date", "Period")), (F.col("v_c"), word("Value", "Index")),
                      (F.col("s_c"), F.when(has_series, word("Series ID", "Code")))]),
        titles(0, "gh"), titles(1, "sh"))
    annual = lambda y: F.aggregate(F.filter("months", lambda x: F.year(x["ms"]) == y), F.lit(0).cast("long"),
                                   lambda a, x: a + x["n"])
    items = books.select("k", "gh", "sh", "o", "d_c", "v_c", "s_c", F.explode(F.concat(
        heads, F.transform("years", lambda y, i: item(1, F.struct(i, y, annual(y)).cast(year))),
        F.transform("months", lambda x, i: item(2, F.struct(
            x["ms"], x["n"], x["amount"], i, F.array_position("years", F.year(x["ms"])) - 1).cast(month))))).alias("item"))
    shown = F.col("item.year.y") + F.when(k % 6 == 5, YEAR_SHIFT - 5).otherwise(YEAR_SHIFT)
    m = F.month("ms")
    rows = items.select(
        "k", "o", "d_c", "v_c", "s_c", "item.head", F.col("item.year.y").alias("y"), "item.month.ms",
        F.when(k % 7 == 3, "s").otherwise("n").alias("year_kind"), shown.cast("string").alias("shown"),
        F.col("item.year.n").cast("string").alias("annual"), F.col("item.month.n").cast("string").alias("n"),
        F.col("item.month.amount").cast("string").alias("amount"), gap["gh"].alias("g_gap"), gap["sh"].alias("s_gap"),
        (F.col("gh") + 1 + F.coalesce("item.year.i", "item.month.grid_i")).alias("gr"),
        (F.col("sh") + 1 + F.col("item.month.i")).alias("sr"))
    rows = rows.withColumns({
        "date": date_text_rule(F.col("ms")), "date_kind": F.when(m % 5 == 0, "d").otherwise("s"),
        "value": F.when(m == 9, F.lit("n/a")).otherwise(F.col("amount")), "series": F.when(has_series, series_text_rule(k, m)),
        "m": m})

    def cell(sheet, c, raw, kind):
        r, g = (F.col("gr"), F.col("g_gap")) if sheet == 0 else (F.col("sr"), F.col("s_gap"))
        return F.struct(F.lit(sheet).alias("sheet_pos"), (r + g).alias("r_raw"), r.alias("r"), c.cast("int").alias("c"),
                        F.col(raw).alias("raw"), (F.lit(kind) if kind in ("s", "n") else F.col(kind)).alias("kind"))

    of_year = F.array(cell(0, o, "shown", "year_kind"), cell(0, o + 13, "annual", "n"))
    of_month = F.array(cell(0, o + F.col("m"), "n", "n"), cell(1, F.col("d_c"), "date", "date_kind"),
                       cell(1, F.col("v_c"), "value", "s"), cell(1, F.col("s_c"), "series", "s"))
    of_head = F.array(F.struct(F.col("head.sheet").alias("sheet_pos"), "head.r_raw", "head.r", "head.c", "head.raw",
                               F.lit("s").alias("kind")))
    cells = rows.select(_supplier_file(k).alias("file"), F.inline(
        F.when(F.col("ms").isNotNull(), of_month).when(F.col("y").isNotNull(), of_year).otherwise(of_head)))
    return cells.filter(F.col("raw").isNotNull()).select(
        "file", F.when(F.col("sheet_pos") == 0, "grid").otherwise("series").alias("sheet"), "sheet_pos", "r_raw", "r", "c",
        "raw", "kind")


def points_manifest(spark: SparkSession, d: str) -> DataFrame:
    """``(file, size, mtime)`` of the suppliers' workbooks: size = shipments,
    mtime = latest ship date."""
    li = read_table(spark, d, "lineitem").select("l_suppkey", "l_shipdate")
    return (li.groupBy(_supplier_file(F.col("l_suppkey")).alias("file"))
            .agg(F.count(F.lit(1)).alias("size"), F.max("l_shipdate").alias("mtime")))


def series_manifest(spark: SparkSession, d: str) -> DataFrame:
    """``(series, file, size, mtime)``: each order priority is a series with one workbook per month,
    there from the 1st of the next month, 8 o'clock; size = orders."""
    o = read_table(spark, d, "orders").select("o_orderpriority", F.trunc("o_orderdate", "month").alias("ms"))
    g = o.groupBy(F.col("o_orderpriority").alias("series"), "ms").agg(F.count(F.lit(1)).alias("size"))
    name = F.concat(F.lower(F.substring("series", 3, 20)), F.lit("-"), F.date_format("ms", "yyyyMM"), F.lit(".xlsx"))
    return g.select("series", name.alias("file"), "size",
                    (F.add_months("ms", 1).cast("timestamp") + F.expr("INTERVAL 8 HOURS")).alias("mtime"))


def timed_requests(spark: SparkSession, d: str) -> DataFrame:
    """``(request_id, series, asked_at)``: one request per order, asked at some hour of its day."""
    o = read_table(spark, d, "orders")
    at = F.col("o_orderdate") + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    return o.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("series"), at.alias("asked_at"))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """``(version, file, size, mtime)``: the workbooks of order months as seen at the end of each year
    (version = year): those of the year and the one before; every third month's is overwritten a
    year later, one byte larger."""
    o = read_table(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("ms"))
    g = o.filter("ms is not null").groupBy("ms").agg(F.count(F.lit(1)).alias("n"))
    again = (F.col("age") == 1) & (F.month("ms") % 3 == 0)
    return g.withColumn("age", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (F.year("ms") + F.col("age")).alias("version"),
        F.concat(F.lit("cpi-u-"), F.date_format("ms", "yyyyMM"), F.lit(".xlsx")).alias("file"),
        (F.col("n") + again.cast("int")).alias("size"),
        F.add_months("ms", F.when(again, 13).otherwise(1)).cast("timestamp").alias("mtime"))


def limit_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests around the service's limits: by supplier, 0, 1, 20, 21, 200 or 201 of the categories of
    its parts (or as many as there are), in the month of its last shipment."""
    li = read_table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate")
    pt = read_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), _category().alias("category"))
    last = li.groupBy("l_suppkey").agg(F.max("l_shipdate").alias("last"))
    some = li.select("l_suppkey", "l_partkey").distinct().join(pt, "l_partkey").select("l_suppkey", "category").distinct()
    names = some.groupBy("l_suppkey").agg(F.sort_array(F.collect_list("category")).alias("names"))     # of its parts
    k = F.col("l_suppkey")
    return names.join(last, "l_suppkey").select(
        k.alias("request_id"), F.slice("names", F.lit(1), _pick([0, 1, 20, 21, 200, 201], k % 6)).alias("categories"),
        F.date_format("last", "yyyy-MM").alias("date"))


def publications(spark: SparkSession, d: str) -> DataFrame:
    """The panel as it was published: each value first 1 too low, at the end of its month; two of
    three months again a month later, as they are."""
    ms = F.to_date("date", "yyyy-MM")
    late = F.when(F.month(ms) % 3 != 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return panel(spark, d).withColumn("k", F.explode(late)).select(
        "category", "date", (F.col("index") - (2 - F.col("k"))).alias("index"), "adjustment",
        F.add_months(ms, F.col("k")).cast("timestamp").alias("published"))


# ---------------------------------------------------------------- messy numbers

def messy_numbers(spark: SparkSession, d: str) -> DataFrame:
    """``events.value`` written in eight styles chosen by ``event_id % 8``."""
    e = read_table(spark, d, "events").select("event_id", "event_type", "value")
    dec = F.col("value").cast("decimal(12,2)")
    t = dec.cast("string")
    style = F.col("event_id") % MESSY_STYLES
    raw = (F.when(style == 0, t)
           .when(style == 1, F.format_number(dec * 1000, 2))
           .when(style == 2, F.concat(t, F.lit("%")))
           .when(style == 3, F.concat(F.lit(" "), t, F.lit("\t")))
           .when(style == 4, F.lit("-"))
           .when(style == 5, F.lit("N/A"))
           .when(style == 6, F.lit("nan"))
           .otherwise(F.concat(F.lit("x"), t)))
    raw = F.when((style == 3) & (F.col("event_id") % 16 == 11),
                 F.concat(F.lit("\u00a0"), t)).otherwise(raw)
    return e.select("event_id", F.col("event_type").alias("category"),
                    raw.alias("raw"), F.lit("s").alias("kind"))


# ---------------------------------------------------------------- requests

def requests(spark: SparkSession, d: str) -> DataFrame:
    """One request per order: date = order month (some unpadded, some bad),
    categories = a comma list of the categories of two parts (the second one's
    number may not exist) with blanks, an unknown and a duplicate mixed in."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    pt = read_table(spark, d, "part")
    one = pt.select(F.col("p_partkey").alias("k1"), _category().alias("c1"))
    two = pt.select(F.col("p_partkey").alias("k2"), _category().alias("c2"))
    o = o.join(one, k % 200 == F.col("k1"), "left").join(two, (k * 7 + 3) % 20000 == F.col("k2"), "left")
    b1 = F.col("c1")
    b2 = F.concat(F.lit(" "), F.col("c2"), F.lit(" "))
    cats = F.concat_ws(",", b1, b2,
                       F.when(k % 5 == 0, b1),
                       F.when(k % 3 == 0, F.lit("Brand#99")),
                       F.when(k % 11 == 0, F.lit(" ")))
    date = (F.when(k % 50 == 7, F.date_format("o_orderdate", "yyyy-M"))
            .when(k % 50 == 13, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-13")))
            .otherwise(F.date_format("o_orderdate", "yyyy-MM")))
    return o.select(k.alias("request_id"), cats.alias("categories"), date.alias("date"))


# ---------------------------------------------------------------- files

def manifest(spark: SparkSession, d: str) -> DataFrame:
    """One workbook per order month (mtime = latest order date + 8 h,
    size = orders); every fourth month also a ``notes-YYYYMM.xls``."""
    o = read_table(spark, d, "orders").select("o_orderdate")
    g = (o.groupBy(F.trunc("o_orderdate", "month").alias("ms"))
         .agg(F.count(F.lit(1)).alias("size"), F.max("o_orderdate").alias("last")))
    ym = F.date_format("ms", "yyyyMM")
    xlsx = g.select(F.concat(F.lit("cpi-u-"), ym, F.lit(".xlsx")).alias("file"),
                    F.col("size"),
                    (F.col("last") + F.expr("INTERVAL 8 HOURS")).alias("mtime"))
    xls = g.filter(F.month("ms") % 4 == 0).select(
        F.concat(F.lit("notes-"), ym, F.lit(".xls")).alias("file"), F.col("size"),
        (F.col("last") + F.expr("INTERVAL 9 HOURS")).alias("mtime"))
    return xlsx.unionByName(xls)


# ---------------------------------------------------------------- links

def listing(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of listing pages made from orders: ``page_id = o_custkey``,
    document position = ``o_orderkey``, four href/text styles."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k = F.col("o_orderkey")
    s = k % 4
    ym = F.date_format("o_orderdate", "yyyyMM")
    month_word = F.date_format("o_orderdate", "MMMM")
    yyyy = F.date_format("o_orderdate", "yyyy")
    href = (F.when(s == 0, F.concat(F.lit("/cpi/tables/supplemental-files/cpi-u-"), ym, F.lit(".xlsx")))
            .when(s == 1, F.concat(F.lit("/files/latest-"), k.cast("string"), F.lit(".xlsx")))
            .when(s == 2, F.concat(F.lit("https://other.example/cpi/data/"), F.lower(month_word),
                                   F.lit("-"), yyyy, F.lit(".xls")))
            .otherwise(F.concat(F.lit("/files/report-"), k.cast("string"), F.lit(".pdf"))))
    text = (F.when(s == 2, F.concat(month_word, F.lit(" "), yyyy, F.lit(" index")))
            .otherwise(F.lit("CPI-U")))
    return o.select(F.col("o_custkey").alias("page_id"), k.alias("pos"),
                    F.lit(LISTING_BASE).alias("base"), href.alias("href"), text.alias("text"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages").select("page_id", "url", "html")
