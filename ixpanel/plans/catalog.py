"""Registered queries: name → callable(spark, sf_dir) → DataFrame.

Each query reads the driver tables (or views Spark derives from them) in full.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import grids as G
from ..operators import links as LK
from ..operators import panel as P
from ..operators import requests as RQ
from ..operators.asof import asof_join
from ..session import scratch_path
from ..sources import cells as SC
from ..sources import files as FS
from ..sources import links as SL
from ..sources import workbook as WB
from ..streaming import ingest as ST
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- panel

@register("mom_change")
def q_mom_change(spark, d):
    return P.mom_change_panel(V.panel(spark, d))


@register("panel_sort")
def q_panel_sort(spark, d):
    return P.panel_sort(V.panel(spark, d))


@register("panel_profile")
def q_panel_profile(spark, d):
    return P.panel_profile(V.panel(spark, d))


# ---------------------------------------------------------------- rendered sheets


AS_OF_MONTH = "2001-12"   # "now" of the link/date rules, a fixed parameter


def _sheet(spark, d):
    """Rendered supplemental sheets, lazily: the branches of a query that read
    them share the aggregation's exchange."""
    return V.sheet_cells(spark, d)


def _pcells(spark, d):
    return V.points_cells(spark, d)


def _own_month_targets(cells):
    """Each workbook's own month, read from its file name."""
    return cells.select("file").distinct().select(
        "file", S.date_from_text(F.col("file"), F.lit(AS_OF_MONTH)).alias("current_month"))


@register("header_row")
def q_header_row(spark, d):
    return G.header_rows(G.first_sheet(_sheet(spark, d)))


@register("category_column")
def q_category_column(spark, d):
    return G.category_column(G.first_sheet(_sheet(spark, d)))


@register("column_map")
def q_column_map(spark, d):
    cells = _sheet(spark, d)
    c1 = G.first_sheet(cells)
    targets = _own_month_targets(cells).join(G.header_rows(c1).select("file", "sheet"), "file")
    return G.column_map(c1, targets)


@register("merged_headers")
def q_merged_headers(spark, d):
    """G2 where the sheets' merged ranges are known: the other columns of a range have its text."""
    cells = _sheet(spark, d)
    c1 = G.unmerge(G.first_sheet(cells), V.merged_ranges(spark, d))
    targets = _own_month_targets(cells).join(G.header_rows(c1).select("file", "sheet"), "file")
    return G.column_map(c1, targets)


@register("sheet_records")
def q_sheet_records(spark, d):
    cells = _sheet(spark, d)
    return G.sheet_records(cells, _own_month_targets(cells)).drop(
        "nsa_previous_mapped", "nsa_current_mapped")


@register("sheet_long")
def q_sheet_long(spark, d):
    cells = _sheet(spark, d)
    rec = G.sheet_records(cells, _own_month_targets(cells))
    wide = rec.select("file", F.col("label").alias("category"), "current_month",
                      S.previous_month(F.col("current_month")).alias("previous_month"),
                      "nsa_previous", "nsa_current", "sa_previous", "sa_current")
    return P.long_format(wide, keys=("file",))


@register("sa_fallback")
def q_sa_fallback(spark, d):
    """No column of any sheet counts as adjusted."""
    cells = _sheet(spark, d).withColumn("raw", F.when(
        F.col("raw") == "Seasonally adjusted indexes", "Other indexes").otherwise(F.col("raw")))
    return G.sheet_records(cells, _own_month_targets(cells)).select(
        "file", "label", "current_month", "nsa_previous", "nsa_current", "sa_previous", "sa_current")


@register("category_catalogue")
def q_category_catalogue(spark, d):
    return G.category_catalogue(_sheet(spark, d))


def _batch(spark, d):
    return RQ.answer(_sheet(spark, d), V.requests(spark, d))


@register("request_valid")
def q_request_valid(spark, d):
    checked = RQ.validate(V.requests(spark, d))
    return checked.select("request_id", "date", "n_categories",
                          F.col("reason").isNull().alias("valid"), "reason")


@register("request_limits")
def q_request_limits(spark, d):
    """F13 in the service's two request forms, each with its own limit."""
    r = V.limit_requests(spark, d)
    forms = [RQ.validate(r, form).withColumn("form", F.lit(form)) for form in ("get", "post")]
    return forms[0].unionByName(forms[1]).select(
        "request_id", "form", "date", "n_categories", F.col("reason").isNull().alias("valid"), "reason")


@register("category_list")
def q_category_list(spark, d):
    checked = RQ.validate(V.requests(spark, d))
    return checked.select("request_id", F.posexplode("category_list").alias("ord", "category"))


@register("month_shift")
def q_month_shift(spark, d):
    r = V.requests(spark, d)
    return r.select("request_id", "date",
                    S.current_month(F.col("date")).alias("current_month"),
                    S.previous_month(F.col("date")).alias("previous_month"))


@register("category_lookup")
def q_category_lookup(spark, d):
    cells = _sheet(spark, d)
    checked = RQ.validate(V.requests(spark, d))
    routed = RQ.route_by_date(RQ.explode_valid(checked))
    c1 = G.first_sheet(cells)
    first = G.category_first_rows(c1, G.category_column(c1))
    q, f = routed.alias("q"), first.alias("f")
    j = q.join(f, (F.col("q.file") == F.col("f.file")) & (F.col("q.ticker") == F.col("f.label")))
    return j.select("q.request_id", "q.ord", "q.ticker", "q.file", "f.r_raw")


@register("wide_record")
def q_wide_record(spark, d):
    return _batch(spark, d)[2]


@register("month_labelled")
def q_month_labelled(spark, d):
    return P.month_labelled(_batch(spark, d)[2])


@register("long_format")
def q_long_format(spark, d):
    return _batch(spark, d)[3]


@register("mom_change_wide")
def q_mom_change_wide(spark, d):
    return P.mom_change_wide(_batch(spark, d)[2])


@register("missing_categories")
def q_missing(spark, d):
    return RQ.missing_categories(_batch(spark, d)[1])


@register("coverage")
def q_coverage(spark, d):
    return RQ.coverage(_batch(spark, d)[1])


def _batch_latest(spark, d):
    return RQ.answer(_sheet(spark, d), V.requests(spark, d), newest=FS.latest_file(V.manifest(spark, d)))


@register("wide_record_latest")
def q_wide_record_latest(spark, d):
    return _batch_latest(spark, d)[2]


@register("coverage_latest")
def q_coverage_latest(spark, d):
    return RQ.coverage(_batch_latest(spark, d)[1])


@register("missing_categories_latest")
def q_missing_latest(spark, d):
    return RQ.missing_categories(_batch_latest(spark, d)[1])


@register("batch_requests")
def q_batch_requests(spark, d):
    return P.panel_sort(_batch(spark, d)[3], "request_id", "ord")


# ---------------------------------------------------------------- other layouts

def _points(spark, d):
    """G8 points."""
    return G.union_layouts(_pcells(spark, d), "cpi")


@register("year_month_unpivot")
def q_year_month_unpivot(spark, d):
    return G.year_month_unpivot(_pcells(spark, d), "cpi")


@register("timeseries_extract")
def q_timeseries_extract(spark, d):
    return G.timeseries_extract(_pcells(spark, d), "cpi")


@register("context_extract")
def q_context_extract(spark, d):
    return G.context_extract(_pcells(spark, d), "cpi")


@register("year_month_context")
def q_year_month_context(spark, d):
    return G.year_month_context(_pcells(spark, d))


@register("union_layouts")
def q_union_layouts(spark, d):
    return _points(spark, d)


@register("recent_periods")
def q_recent_periods(spark, d):
    return P.recent_periods(_points(spark, d), 2, by=["file"])


@register("layout_stats")
def q_layout_stats(spark, d):
    return P.layout_stats(_points(spark, d))


def _stored(spark, cells, tag):
    """``cells`` written as a stored cell table under the shared checkpoint folder, and read from there."""
    path = scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")
    SC.write_cells(cells, path)
    return SC.read_cells(spark, path)


@register("latest_points")
def q_latest_points(spark, d):
    """R18 on the stored cell table: only the newest workbook's part is read."""
    latest = FS.latest_file(V.points_manifest(spark, d)).select("file")      # one row
    cells = SC.of_files(_stored(spark, _pcells(spark, d), "points"), latest)
    pts = P.recent_periods(G.union_layouts(cells, "cpi"), 2, by=["file"])
    return pts.withColumn("period", S.period_label(F.col("year"), F.col("month")))


def _below_header(cells, column):
    """Cells below the header that are in the column G5 finds for a role."""
    j = cells.join(G.layout_facts(cells).select("file", "sheet", "hr5", column), ["file", "sheet"])
    return j.filter((F.col("c") == F.col(column)) & (F.col("r") > F.col("hr5")))


@register("parse_period")
def q_parse_period(spark, d):
    c = _below_header(V.points_cells(spark, d), "d_c")
    p = S.parse_period(F.col("raw"), F.col("kind"))
    return c.select("file", "r", "raw", p["year"].alias("year"), p["month"].alias("month"))


@register("seasonal_flag")
def q_seasonal_flag(spark, d):
    c = _below_header(V.points_cells(spark, d), "s_c")
    return c.select("file", "r", "raw", S.seasonal_flag(F.col("raw")).alias("seasonally_adjusted"))


@register("four_digit_year")
def q_four_digit_year(spark, d):
    c = _pcells(spark, d)
    return c.select("file", "sheet", "r", "c", S.four_digit_year(F.col("raw")).alias("year")) \
            .filter(F.col("year").isNotNull())


# ---------------------------------------------------------------- numbers

@register("clean_numeric")
def q_clean_numeric(spark, d):
    m = V.messy_numbers(spark, d)
    return m.select("event_id", "raw", S.clean_numeric(F.col("raw")).alias("value"))


@register("is_numeric")
def q_is_numeric(spark, d):
    m = V.messy_numbers(spark, d)
    return m.select("event_id", S.is_numeric(F.col("raw"), F.col("kind")).alias("numeric"))


@register("numeric_quality")
def q_numeric_quality(spark, d):
    return P.numeric_quality(V.messy_numbers(spark, d), "category")


# ---------------------------------------------------------------- files


AS_OF = "2001-08-01 20:00:00"       # the "now" of the age rules, a fixed parameter
KNOWN_BEFORE = "2001-06-01 00:00:00"


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@register("file_manifest")
def q_file_manifest(spark, d):
    m = FS.file_manifest(V.manifest(spark, d))
    return m.select("file", "size", _ts(F.col("mtime")).alias("mtime"))


@register("latest_file")
def q_latest_file(spark, d):
    return FS.latest_file(V.manifest(spark, d)).select("file", _ts(F.col("mtime")).alias("mtime"))


@register("latest_file_by_series")
def q_latest_file_by_series(spark, d):
    """S4 per series."""
    return FS.latest_file(V.series_manifest(spark, d), by=["series"]).select(
        "series", "file", _ts(F.col("mtime")).alias("mtime"))


@register("asof_workbook")
def q_asof_workbook(spark, d):
    """S4 and R17 in time: for each request the newest workbook of its series that was there."""
    found = asof_join(V.timed_requests(spark, d), V.series_manifest(spark, d), ["series"], "asked_at", "mtime",
                      ["mtime", "file"])
    return found.select("request_id", "series", _ts(F.col("asked_at")).alias("asked_at"), "file", _ts(F.col("mtime")).alias("mtime"))


@register("manifest_changes")
def q_manifest_changes(spark, d):
    """S9 in full, for every version of a manifest."""
    c = FS.snapshot_changes(V.snapshots(spark, d))
    return c.select("version", "file", "kind", "old_size", "size", _ts(F.col("old_mtime")).alias("old_mtime"),
                    _ts(F.col("mtime")).alias("mtime"))


@register("file_names_desc")
def q_file_names_desc(spark, d):
    return FS.file_names_desc(V.manifest(spark, d))


@register("file_info")
def q_file_info(spark, d):
    fi = FS.file_info(V.points_manifest(spark, d), _pcells(spark, d))
    return fi.withColumn("mtime", _ts(F.col("mtime")))


@register("new_files")
def q_new_files(spark, d):
    m = V.manifest(spark, d)
    known = m.filter(F.col("mtime") < F.lit(KNOWN_BEFORE).cast("timestamp"))
    return FS.new_files(m, known).select("file", "size", _ts(F.col("mtime")).alias("mtime"))


@register("fresh_files")
def q_fresh_files(spark, d):
    m = V.manifest(spark, d)
    dl = FS.fresh_files(m, AS_OF, 6).withColumnRenamed("fresh", "fresh_download")
    sv = FS.fresh_files(dl, AS_OF, 24).withColumnRenamed("fresh", "fresh_serve")
    return sv.select("file", _ts(F.col("mtime")).alias("mtime"), "fresh_download", "fresh_serve")


@register("retention")
def q_retention(spark, d):
    r = FS.retention(V.manifest(spark, d), AS_OF, 30)
    return r.select("file", _ts(F.col("mtime")).alias("mtime"), "action")


@register("source_status")
def q_source_status(spark, d):
    cat = G.category_catalogue(_sheet(spark, d))
    st = FS.source_status(V.manifest(spark, d), cat)
    return st.withColumn("latest_mtime", _ts(F.col("latest_mtime")))


# ---------------------------------------------------------------- links


TARGET_MONTH = "1998-06"


@register("listing_links")
def q_listing_links(spark, d):
    a = LK.resolve(SL.anchors(V.pages(spark, d)))
    return a.select("page_id", "pos", "href", "text", "url", "filename")


@register("url_resolve")
def q_url_resolve(spark, d):
    a = LK.resolve(V.listing(spark, d))
    return a.select("page_id", "pos", "url", "filename")


@register("date_from_text")
def q_date_from_text(spark, d):
    a = LK.resolve(V.listing(spark, d))
    return a.select("page_id", "pos", S.date_from_text(
        F.concat_ws(" ", F.col("text"), F.col("filename")), F.lit(AS_OF_MONTH)).alias("date"))


@register("month_from_text")
def q_month_from_text(spark, d):
    a = V.listing(spark, d)
    return a.select("page_id", "pos", S.month_from_text(F.col("text")).alias("month"))


@register("link_priority")
def q_link_priority(spark, d):
    return LK.workbook_links(V.listing(spark, d), AS_OF_MONTH)


@register("link_rank")
def q_link_rank(spark, d):
    return LK.link_rank(LK.workbook_links(V.listing(spark, d), AS_OF_MONTH))


@register("link_target")
def q_link_target(spark, d):
    return LK.link_target(LK.workbook_links(V.listing(spark, d), AS_OF_MONTH), TARGET_MONTH)


# ---------------------------------------------------------------- stored cells and sinks


@register("scan_first_sheet")
def q_scan_first_sheet(spark, d):
    cells = _stored(spark, V.sheet_cells(spark, d), "sheets")
    return G.sheet_records(cells, _own_month_targets(cells)).drop(
        "nsa_previous_mapped", "nsa_current_mapped")


@register("scan_all_sheets")
def q_scan_all_sheets(spark, d):
    return G.union_layouts(_stored(spark, V.points_cells(spark, d), "points"), "cpi")


@register("records_parquet")
def q_records_parquet(spark, d):
    wide = _batch(spark, d)[2]
    out = scratch_path(spark, f"records-{uuid.uuid4().hex}")
    WB.records_out(wide, out)
    return spark.read.schema(wide.schema).parquet(out)


@register("records_out")
def q_records_out(spark, d):
    wide = _batch(spark, d)[2]
    out = scratch_path(spark, f"records-{uuid.uuid4().hex}")
    WB.records_out(wide, out, "json")
    return spark.read.schema(wide.schema).json(out)


# ---------------------------------------------------------------- streaming


def _drop_panel(spark, d, tag):
    """Write the panel's publications as several Parquet files into a fresh drop folder under the
    shared checkpoint folder, dealt so that a later one may arrive first."""
    root = scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")
    V.publications(spark, d).repartition(6, "category", "date", "published").write.parquet(f"{root}/drop")
    return root


@register("stream_ingest")
def q_stream_ingest(spark, d):
    root = _drop_panel(spark, d, "stream-ingest")
    q = ST.stream_ingest(spark, f"{root}/drop", f"{root}/table", f"{root}/ckpt", schema=ST.PUBLISHED_SCHEMA,
                         max_files_per_trigger=2)
    q.awaitTermination()
    return ST.read_table(spark, f"{root}/table")


@register("stream_latest")
def q_stream_latest(spark, d):
    root = _drop_panel(spark, d, "stream-latest")
    q = ST.stream_latest(spark, f"{root}/drop", f"{root}/table", f"{root}/latest",
                         f"{root}/ckpt", n=2, schema=ST.PUBLISHED_SCHEMA, max_files_per_trigger=2)
    q.awaitTermination()
    return ST.read_latest(spark, f"{root}/latest")


@register("panel_profile_merged")
def q_panel_profile_merged(spark, d):
    """R12 from the parts of each year, merged."""
    by_year = V.panel(spark, d).withColumn("year", F.substring("date", 1, 4))
    p = P.merge_profiles(*P.profile_partial(by_year, "year"))
    near = F.abs(F.col("about_categories") - F.col("n_categories")) <= 0.05 * F.col("n_categories")
    return p.select("n_rows", "n_categories", "first_date", "last_date", "adjustments", near.alias("estimate_is_near"))


# ---------------------------------------------------------------- R9 ordered caps

@register("limit_head")
def q_limit_head(spark, d):
    """The sample of the newest points shown after an ingest: the first 3
    points in a total order (newest period first)."""
    pts = q_latest_points(spark, d)
    return P.limit_head(pts, 3, F.desc("year"), F.desc("month"), "file", "sheet", "layout", "r", "c")


@register("top_links")
def q_top_links(spark, d):
    """R9 per page: the first 5 links of every listing page."""
    links = LK.workbook_links(V.listing(spark, d), AS_OF_MONTH)
    return P.top_per_group(links, ["page_id"], [F.col("priority"), F.desc("date"), F.col("pos")], 5).select(
        "page_id", "rank", "pos", "filename", "date", "priority")


# F12 as a table: other rules than the service's.
RULES = [(1, "text", r"(?i)\bindex$"), (2, "href", r"(?i)/latest-[0-9]*[02468]\.xlsx?$"), (3, "href", r"(?i)latest"),
         (9, "text", r"(?i)cpi")]


@register("link_rules")
def q_link_rules(spark, d):
    rules = spark.createDataFrame(RULES, "priority int, field string, pattern string")
    return LK.workbook_links(V.listing(spark, d), AS_OF_MONTH, LK.rule_table(rules)).select(
        "page_id", "pos", "filename", "date", "priority")


# ---------------------------------------------------------------- F8, F9 on their own

@register("header_norm")
def q_header_norm(spark, d):
    """F8 over the header and sub-header rows of every rendered sheet."""
    cells = _sheet(spark, d)
    c = cells.join(G.header_rows(cells), ["file", "sheet"]) \
             .filter((F.col("r_raw") - F.col("header_r")).between(0, 1))
    return c.select("file", "r_raw", "c", S.header_norm(F.col("raw")).alias("text"),
                    S.header_norm(F.col("raw"), strip=True).alias("text_stripped"))


@register("series_label")
def q_series_label(spark, d):
    """default series id of each workbook's ticker (its file stem)."""
    m = V.points_manifest(spark, d)
    ticker = F.regexp_extract(F.col("file"), r"^(.*)\.xlsx$", 1)
    return m.select("file", ticker.alias("ticker"), S.series_label(ticker).alias("series_id"))


def _drop_cells(spark, cells, tag):
    """Write workbooks' cells as Parquet files, each workbook's in one, into a fresh drop folder."""
    root = scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")
    cells.repartition(6, "file").write.parquet(f"{root}/drop")
    return root


def _streamed(spark, root):
    q = ST.stream_workbooks(spark, f"{root}/drop", f"{root}/out", f"{root}/ckpt", max_files_per_trigger=2, fmt="parquet")
    q.awaitTermination()


@register("stream_workbooks")
def q_stream_workbooks(spark, d):
    """T1 as the original runs it: new workbooks arrive in a folder and their
    points are extracted incrementally."""
    root = _drop_cells(spark, V.points_cells(spark, d), "stream-workbooks")
    _streamed(spark, root)
    return ST.read_committed(spark, f"{root}/out", "points")


@register("stream_quarantine")
def q_stream_quarantine(spark, d):
    """T1 with workbooks that can't be read (every 11th supplier's): what became of each workbook."""
    cells = V.points_cells(spark, d)
    broken = F.regexp_extract("file", "([0-9]+)", 1).cast("long") % 11 == 3
    bad = cells.filter(broken).select("file").distinct().select(
        "file", *[F.lit(None).cast(t).alias(c) for c, t in cells.dtypes if c not in ("file", "raw", "kind")],
        F.lit("not a workbook").alias("raw"), F.lit(WB.ERROR).alias("kind")).select(cells.columns)
    root = _drop_cells(spark, cells.filter(~broken).unionByName(bad), "stream-quarantine")
    _streamed(spark, root)
    points = ST.read_committed(spark, f"{root}/out", "points").groupBy("file").agg(F.count(F.lit(1)).alias("n_points"))
    unreadable = ST.read_committed(spark, f"{root}/out", "unreadable")
    return points.join(unreadable, "file", "full").select(
        "file", F.coalesce("n_points", F.lit(0).cast("long")).alias("n_points"), "problem")


@register("period_label")
def q_period_label(spark, d):
    """F15 over every extracted point."""
    return _points(spark, d).select("file", "sheet", "layout", "r", "c",
                                    S.period_label(F.col("year"), F.col("month")).alias("period"))
