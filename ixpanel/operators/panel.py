"""Relational operators on the panel and on wide records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S

WIDE_VALUES = ["nsa_previous", "nsa_current", "sa_previous", "sa_current"]


def round2(x: Column) -> Column:
    """Round to 2 places the numpy way: scale, round half to even, unscale."""
    return F.rint(x * F.lit(100.0)) / F.lit(100.0)


def pct_change(cur: Column, prev: Column) -> Column:
    """``((cur - prev) / prev * 100)`` rounded by ``round2``. Division by
    zero gives null (documented deviation: pandas gives ±inf)."""
    return round2((cur - prev) / F.when(prev != 0, prev) * F.lit(100.0))


def mom_change_panel(panel: DataFrame) -> DataFrame:
    """R6 over a whole panel: change to the calendar-previous month of the same
    category and adjustment.

    ``lag`` runs in windows partitioned by (category, adjustment); a window
    holds one row per month, so its size is bounded by the months covered.
    A gap in the months gives a null previous value, not an older month.
    """
    w = Window.partitionBy("category", "adjustment").orderBy("date")
    prev_date = F.date_format(F.add_months(F.to_date(F.col("date"), "yyyy-MM"), -1), "yyyy-MM")
    p = (panel
         .withColumn("_ld", F.lag("date").over(w))
         .withColumn("_li", F.lag("index").over(w)))
    prev_index = F.when(F.col("_ld") == prev_date, F.col("_li"))
    return (p.withColumn("prev_index", prev_index)
            .withColumn("mom_change_pct", pct_change(F.col("index"), F.col("prev_index")))
            .drop("_ld", "_li"))


def mom_change_wide(wide: DataFrame) -> DataFrame:
    """R6 on wide records: NSA and SA month-over-month change."""
    return (wide
            .withColumn("nsa_mom_change_pct", pct_change(F.col("nsa_current"), F.col("nsa_previous")))
            .withColumn("sa_mom_change_pct", pct_change(F.col("sa_current"), F.col("sa_previous"))))


def long_format(wide: DataFrame, keys=("request_id", "ord")) -> DataFrame:
    """Wide → ``category, date, index, adjustment``; null and NaN dropped.

    ``wide`` carries ``category, current_month, previous_month`` and the four
    value columns. Output order is set by ``panel_sort`` where needed.
    """
    keys = [k for k in keys if k in wide.columns]
    stacked = F.inline(F.array(
        F.struct(F.col("previous_month").alias("date"), F.col("nsa_previous").alias("index"),
                 F.lit("nsa").alias("adjustment")),
        F.struct(F.col("current_month").alias("date"), F.col("nsa_current").alias("index"),
                 F.lit("nsa").alias("adjustment")),
        F.struct(F.col("previous_month").alias("date"), F.col("sa_previous").alias("index"),
                 F.lit("sa").alias("adjustment")),
        F.struct(F.col("current_month").alias("date"), F.col("sa_current").alias("index"),
                 F.lit("sa").alias("adjustment"))))
    out = wide.select(*keys, "category", stacked)
    return out.filter(F.col("index").isNotNull() & ~F.isnan("index"))


def month_labelled(wide: DataFrame) -> DataFrame:
    """The older record shape with month-labelled value columns."""
    keep = [c for c in ("request_id", "ord") if c in wide.columns]
    return wide.select(*keep, "category", "current_month", "previous_month",
                       F.col("nsa_previous").alias("nsa_previous_month"),
                       F.col("nsa_current").alias("nsa_current_month"),
                       F.col("sa_previous").alias("sa_previous_month"),
                       F.col("sa_current").alias("sa_current_month"))


def wide_for_date(wide: DataFrame, date: str) -> DataFrame:
    """R2 for one request date: value columns named ``nsa_YYYY-MM`` etc.

    The names are known from the date, so the schema is fixed up front.
    """
    from datetime import datetime
    cur = datetime.strptime(date, "%Y-%m")
    prev_y, prev_m = (cur.year, cur.month - 1) if cur.month > 1 else (cur.year - 1, 12)
    c, p = f"{cur.year:04d}-{cur.month:02d}", f"{prev_y:04d}-{prev_m:02d}"
    return wide.select("category",
                       F.col("nsa_previous").alias(f"nsa_{p}"), F.col("nsa_current").alias(f"nsa_{c}"),
                       F.col("sa_previous").alias(f"sa_{p}"), F.col("sa_current").alias(f"sa_{c}"))


def recent_periods(points: DataFrame, n: int = fixed.RECENT_PERIODS,
                   by: list[str] | None = None) -> DataFrame:
    """Keep rows of the latest ``n`` (year, month) periods.

    Rows with a null or zero year or month are dropped. Without ``by`` the
    distinct periods are reduced to the top ``n`` (at most ``n`` rows) for a
    semi-join. With ``by`` (e.g. per file, bounded by the file) periods are
    ranked in a window, in one pass over the points; Spark keeps the ranks up
    to ``n`` of each task before it shuffles.
    """
    ok = points.filter(F.coalesce(F.col("year"), F.lit(0)) != 0) \
               .filter(F.coalesce(F.col("month"), F.lit(0)) != 0)
    if not by:
        top = (ok.select("year", "month").distinct()
               .orderBy(F.desc("year"), F.desc("month")).limit(n))
        return ok.join(top, ["year", "month"], "left_semi")
    w = Window.partitionBy(*by).orderBy(F.desc("year"), F.desc("month"))
    return ok.withColumn("_k", F.dense_rank().over(w)).filter(F.col("_k") <= n).drop("_k")


def limit_head(df: DataFrame, n: int, *order) -> DataFrame:
    """Ordered cap (a top-k report); always ordered before limiting."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """R9 per group: the first ``n`` rows of each group by ``order`` (end it with a unique key), with
    their position ``rank``. Each task keeps at most ``n`` rows of a group before the shuffle, so a
    hot group costs ``n`` rows a task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def panel_sort(df: DataFrame, *ties: str) -> DataFrame:
    """Order by category, date, adjustment, then ``ties`` (range-partitioned
    sort; unique last keys let a popular category and month split)."""
    return df.orderBy("category", "date", "adjustment", *ties)


def panel_profile(panel: DataFrame) -> DataFrame:
    """Rows, distinct categories, first and last month, adjustments."""
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("category").alias("n_categories"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.array_join(F.sort_array(F.collect_set("adjustment")), ",").alias("adjustments"))


def profile_partial(panel: DataFrame, batch: str) -> tuple[DataFrame, DataFrame]:
    """R12 in parts: one row per ``batch`` (counts, extremes, a sketch of the categories), and the
    batches' distinct (batch, category, adjustment). Both are kept; ``merge_profiles`` reads them
    instead of the panel."""
    parts = panel.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.hll_sketch_agg("category").alias("categories"))
    return parts, panel.select(batch, "category", "adjustment").distinct()


def merge_profiles(parts: DataFrame, sets: DataFrame) -> DataFrame:
    """R12 from the parts of any batches, without their rows: exact, and the sketch's estimate
    (``about_categories``), which needs the parts alone."""
    names = sets.agg(F.countDistinct("category").alias("n_categories"),
                     F.array_join(F.sort_array(F.collect_set("adjustment")), ",").alias("adjustments"))
    one = parts.agg(F.sum("n_rows").alias("n_rows"), F.min("first_date").alias("first_date"),
                    F.max("last_date").alias("last_date"),
                    F.hll_sketch_estimate(F.hll_union_agg("categories")).alias("about_categories"))
    return one.select(F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"),
                      names.select("n_categories").scalar().alias("n_categories"), "first_date", "last_date",
                      names.select("adjustments").scalar().alias("adjustments"), "about_categories")


def numeric_quality(cells: DataFrame, by: str = "category") -> DataFrame:
    """Per group, cells that parse, placeholders and unparsable text."""
    v = S.clean_numeric(F.col("raw"))
    ph = S.is_placeholder(F.col("raw"))
    return (cells.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(v.isNotNull()).alias("n_parsed"),
        F.count_if(ph).alias("n_placeholder"),
        F.count_if(v.isNull() & ~ph).alias("n_unparsable"),
        F.sum(v.cast("decimal(18,2)")).cast("double").alias("sum_parsed")))


def layout_stats(points: DataFrame) -> DataFrame:
    """Extracted points per file, sheet and layout."""
    return points.groupBy("file", "sheet", "layout").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.countDistinct("year", "month").alias("n_periods"))
