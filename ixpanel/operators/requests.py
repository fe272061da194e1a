"""Batch requests.

The original service answers one ``(categories, date)`` request at a time by
scanning a sheet once per category. Here every request of a batch is answered
at once: requests are exploded to one row per asked category and joined with
a per-sheet index of first rows (one hash join instead of a scan per name).
The side sizes are measured at run time by AQE, which broadcasts the sheet
index when it is small and falls back to a shuffle join when it is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from . import grids as G
from . import panel as P


LIMITS = {"get": fixed.MAX_CATEGORIES_GET, "post": fixed.MAX_CATEGORIES_POST, "batch": None}


def validate(requests: DataFrame, form: str = "batch") -> DataFrame:
    """F13 + F14: parsed category list, its size, and the rejection reason
    (null when valid). ``categories`` may be a comma string (split and
    stripped) or an array (taken as given). The service's request forms limit
    the number of categories (``get`` 20, ``post`` 200); a batch has no limit."""
    max_categories = LIMITS[form]
    dtype = dict(requests.dtypes)["categories"]
    lst = S.category_list(F.col("categories")) if dtype == "string" else F.col("categories")
    r = requests.withColumn("category_list", lst) \
                .withColumn("n_categories", F.size("category_list"))
    return r.withColumn("reason", S.request_reject_reason(F.col("date"), F.col("n_categories"),
                                                          max_categories))


def explode_valid(checked: DataFrame) -> DataFrame:
    """Valid requests → ``request_id, ord, ticker, date, current_month,
    previous_month`` (``ord`` = position in the request, from 0)."""
    # Months and names are made once a request, in a step that no filter of the joins above passes:
    # pushed below it, each would work out the date anew, in one method too long for the JVM to compile.
    # A rejected request gives a row without a name, dropped at the end.
    v = checked.select("request_id", "date", F.inline_outer(F.array(F.when(F.col("reason").isNull(), F.struct(
        F.col("category_list").alias("asked"), S.current_month(F.col("date")).alias("current_month"),
        S.previous_month(F.col("date")).alias("previous_month"))))))
    return v.select("request_id", "date", F.posexplode_outer("asked").alias("ord", "ticker"),
                    "current_month", "previous_month").filter(F.col("ord").isNotNull())


def route_by_date(exploded: DataFrame) -> DataFrame:
    """Send each request to the workbook published for its month
    (``cpi-u-YYYYMM.xlsx``, the link-target naming rule)."""
    ym = F.replace(F.col("current_month"), F.lit("-"), F.lit(""))
    return exploded.withColumn("file", F.concat(F.lit("cpi-u-"), ym, F.lit(".xlsx")))


def route_latest(exploded: DataFrame, newest: DataFrame) -> DataFrame:
    """Send every request to the newest workbook (``file``, one row at most) whatever its month, as
    the service does: a name found there is found, and months the workbook doesn't map have null values."""
    return exploded.withColumn("file", newest.select("file").scalar())


def month_of_workbook(cells: DataFrame) -> DataFrame:
    """``file, current_month`` for workbooks named ``cpi-u-YYYYMM.xlsx`` — the
    only month ``route_by_date`` can send to them."""
    m = F.regexp_extract(F.col("file"), r"(?i)^cpi-u-([0-9]{4})([0-9]{2})\.xlsx$", 0)
    ym = F.concat_ws("-", F.regexp_extract(F.col("file"), r"(?i)^cpi-u-([0-9]{4})([0-9]{2})\.xlsx$", 1),
                     F.regexp_extract(F.col("file"), r"(?i)^cpi-u-([0-9]{4})([0-9]{2})\.xlsx$", 2))
    return (cells.select("file").distinct().filter(m != "")
            .select("file", ym.alias("current_month")))


def lookup(cells: DataFrame, routed: DataFrame, fill_merged: bool = False,
           targets: DataFrame | None = None) -> DataFrame:
    """Every asked name (one row per request position) with ``found`` and,
    when found, its four values — one left join of the exploded requests with
    the per-sheet records; it serves R2 (found rows), R11 (the others) and
    R10 (one grouped count).

    ``targets`` (``file, current_month``) names the months to map per
    workbook; by default they are read from the requests (one extra pass).
    With ``route_by_date`` they follow from the file names
    (``month_of_workbook``), so the requests are read once.
    """
    if targets is None:
        targets = routed.select("file", "current_month").distinct()
    recs = G.sheet_records(cells, targets, fill_merged).alias("s")
    q = routed.alias("q")
    j = q.join(recs, (F.col("q.file") == F.col("s.file"))
               & (F.col("q.current_month") == F.col("s.current_month"))
               & (S.ustrip(F.col("q.ticker")) == F.col("s.label")), "left")
    return j.select("q.request_id", "q.ord", "q.date", F.col("q.ticker").alias("category"),
                    "q.current_month", "q.previous_month", F.col("s.label").isNotNull().alias("found"),
                    "s.nsa_previous", "s.nsa_current", "s.sa_previous", "s.sa_current")


def wide_records(cells: DataFrame, routed: DataFrame, fill_merged: bool = False,
                 targets: DataFrame | None = None) -> DataFrame:
    """R1 + R2 + R3: one wide record per found (request, position).

    Unknown names are dropped, duplicates kept, the output name is the name
    as asked. Unmapped NSA months stay null; an unmapped SA month takes the
    NSA value (column-level fallback).
    """
    return found_records(lookup(cells, routed, fill_merged, targets))


def found_records(looked_up: DataFrame) -> DataFrame:
    return looked_up.filter("found").drop("found", "date")


def missing_categories(looked_up: DataFrame) -> DataFrame:
    """Asked names that found no row."""
    return looked_up.filter(~F.col("found")).select("request_id", "ord",
                                                    F.col("category").alias("ticker"))


def coverage(looked_up: DataFrame) -> DataFrame:
    """Requested / found / failed counts, success flag and message per
    valid request, for the wide answer (rows found) and the long answer
    (distinct names with at least one value) — one aggregation over the
    looked-up rows (a request holds at most its category limit of rows)."""
    has_value = F.lit(False)
    for c in ("nsa_previous", "nsa_current", "sa_previous", "sa_current"):
        has_value = has_value | (F.col(c).isNotNull() & ~F.isnan(c))
    j = looked_up.groupBy("request_id", "date").agg(
        F.count(F.lit(1)).cast("int").alias("requested"),
        F.count_if("found").alias("found_wide"),
        F.count_distinct(F.when(F.col("found") & has_value, F.col("category"))).alias("found_long"))

    def msg(found, suffix):
        ok = F.format_string(fixed.MSG_OK.replace("{n}", "%d").replace("{suffix}", suffix), found)
        empty = F.format_string(fixed.MSG_EMPTY.replace("{date}", "%s"), F.col("date"))
        return F.when(found > 0, ok).otherwise(empty)

    return j.select(
        "request_id", "date", "requested",
        F.col("found_wide"), (F.col("requested") - F.col("found_wide")).alias("failed_wide"),
        (F.col("found_wide") > 0).alias("success_wide"),
        msg(F.col("found_wide"), "").alias("message_wide"),
        F.col("found_long"), (F.col("requested") - F.col("found_long")).alias("failed_long"),
        (F.col("found_long") > 0).alias("success_long"),
        msg(F.col("found_long"), fixed.MSG_OK_LONG_SUFFIX).alias("message_long"))


def answer(cells: DataFrame, requests: DataFrame, form: str = "batch",
           newest: DataFrame | None = None):
    """The whole batch — validation, routing, lookup; the wide and long
    answers. Returns ``(checked, looked_up, wide, long)``. With ``newest``
    (``file``, one row at most) every request goes to that workbook, whatever its month."""
    checked = validate(requests, form)
    exploded = explode_valid(checked)
    if newest is None:
        looked_up = lookup(cells, route_by_date(exploded), targets=month_of_workbook(cells))
    else:
        looked_up = lookup(cells.filter(F.col("file") == newest.select("file").scalar()),
                           route_latest(exploded, newest))
    wide = found_records(looked_up)
    return checked, looked_up, wide, P.long_format(wide)
