"""Workbook links on listing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranking import rank_within


def resolve(anchors: DataFrame) -> DataFrame:
    """absolute URL and file name of every anchor."""
    url = S.url_resolve(F.col("base"), F.col("href"))
    return anchors.withColumn("url", url).withColumn("filename", S.url_filename(F.col("url")))


MAX_RULES = 200          # patterns become one expression each


def rule_table(rules: DataFrame) -> list[tuple[int, str, str]]:
    """F12 as a table: ``priority, field`` (``href`` or ``text``), ``pattern`` (a regular expression to
    be found there). At most MAX_RULES rows; a greater table is an error, not cut."""
    rows = rules.select("priority", "field", "pattern").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES or any(r.field not in ("href", "text") for r in rows):
        raise ValueError(f"at most {MAX_RULES} rules, on href or text")
    return [tuple(r) for r in rows]


def rule_priority(rules: list[tuple[int, str, str]]) -> Column:
    """The least priority among the rules that hold; null if none does. The patterns are compiled once."""
    found = [F.when(F.coalesce(F.col(field), F.lit("")).rlike(pattern), F.lit(priority))
             for priority, field, pattern in rules]
    return F.array_min(F.array(*found)) if found else F.lit(None).cast("int")


def workbook_links(anchors: DataFrame, as_of_month: str, rules: list[tuple[int, str, str]] | None = None) -> DataFrame:
    """F12 + F6 + F10: anchors that look like index workbooks, with priority
    and the month read from text and file name (``as_of_month`` when none).
    ``rules`` (``rule_table``) take the place of the service's own."""
    r = resolve(anchors)
    pr = S.link_priority(F.col("href"), F.col("text")) if rules is None else rule_priority(rules)
    out = (r.withColumn("priority", pr).filter(F.col("priority").isNotNull())
           .withColumn("date", S.date_from_text(F.concat_ws(" ", F.col("text"), F.col("filename")),
                                                F.lit(as_of_month))))
    return out.select("page_id", "pos", "url", "filename", "date",
                      F.col("text").alias("description"), F.col("text").alias("link_text"),
                      "priority")


def _yyyymm(date_col):
    """Sort number of a link date: digits of ``YYYY-MM``, missing → 0."""
    d = F.regexp_replace(date_col, "-", "")
    return F.coalesce(F.when(d.rlike(r"^[0-9]+$"), d.try_cast("bigint")), F.lit(0))


def link_rank(links: DataFrame) -> DataFrame:
    """Rank per page by priority, then date (newest first), then
    document position. Skew-safe: range-partitioned numbering."""
    k = links.withColumn("_ym", _yyyymm(F.col("date")))
    out = rank_within(k, ["page_id"], [F.col("priority"), F.desc("_ym"), F.col("pos")])
    return out.drop("_ym")


def link_target(links: DataFrame, target_date: str) -> DataFrame:
    """The link to fetch per page for ``target_date`` (``YYYY-MM``):
    an exact ``cpi-u-YYYYMM.xlsx`` name first, else a date or name match,
    else the best-ranked link. One grouped ``min_by`` — no per-page sort."""
    ym = target_date.replace("-", "")
    fname = F.lower(F.col("filename"))
    tier = (F.when(fname.contains(f"cpi-u-{ym}.xlsx"), 1)
            .when(F.col("date").contains(target_date) | F.col("filename").contains(ym), 2)
            .otherwise(3))
    k = links.withColumn("tier", tier).withColumn("_ym", _yyyymm(F.col("date")))
    best = F.min_by(F.struct("pos", "url", "filename", "date", "priority", "tier"),
                    F.struct("tier", "priority", (-F.col("_ym")).alias("neg_ym"), "pos"))
    return k.groupBy("page_id").agg(best.alias("b")).select("page_id", "b.*")
