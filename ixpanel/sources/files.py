"""Workbook directories as manifests.

A manifest is ``(file, size, mtime)``; on a real directory it comes from the
``binaryFile`` source with the content column pruned, so listing touches only
file metadata. Every age rule takes an explicit ``as_of`` timestamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed


def scan_directory(spark: SparkSession, path: str, glob: str = fixed.WORKBOOK_GLOB) -> DataFrame:
    """S3 source: list workbooks of a directory (metadata only)."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .load(path))
    return df.select(F.substring_index("path", "/", -1).alias("file"),
                     F.col("length").alias("size"),
                     F.col("modificationTime").alias("mtime"),
                     F.col("path"))


def workbooks(manifest: DataFrame, glob_suffix: str = ".xlsx") -> DataFrame:
    """Only the files the workbook glob matches (``.xls`` is not globbed)."""
    return manifest.filter(F.lower(F.col("file")).endswith(glob_suffix))


def file_manifest(manifest: DataFrame) -> DataFrame:
    """S3: workbooks, newest first (ties by name)."""
    return workbooks(manifest).orderBy(F.desc("mtime"), F.desc("file"))


def latest_file(manifest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Newest workbook (ties → greatest name); one row, or one per group.
    A global aggregate with partial aggregation, no sort of the manifest."""
    m = workbooks(manifest)
    key = F.struct("mtime", "file")
    agg = [F.max_by("file", key).alias("file"), F.max("mtime").alias("mtime")]
    return m.groupBy(*by).agg(*agg) if by else m.agg(*agg).filter(F.col("file").isNotNull())


def file_names_desc(manifest: DataFrame) -> DataFrame:
    """Workbook names in descending name order (not by time)."""
    return workbooks(manifest).select("file").orderBy(F.desc("file"))


def file_info(manifest: DataFrame, cells: DataFrame) -> DataFrame:
    """Name, sheet names in workbook order, sheet count, size, mtime."""
    sheets = (cells.select("file", "sheet_pos", "sheet").distinct()
              .groupBy("file").agg(
                  F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sheet_pos", "sheet"))),
                                           lambda s: s["sheet"]), ",").alias("sheets"),
                  F.count(F.lit(1)).alias("n_sheets")))
    return manifest.join(sheets, "file", "left").fillna(0, ["n_sheets"]) \
                   .select("file", "sheets", "n_sheets", "size", "mtime")


def new_files(current: DataFrame, known: DataFrame) -> DataFrame:
    """Workbooks present now and not before (anti-join on name)."""
    return workbooks(current).join(known.select("file"), "file", "left_anti")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """S9 in full: what happened to each workbook between two manifests — ``added``, ``changed``
    (another size or time, so an overwritten file counts) or ``removed``."""
    return snapshot_changes(workbooks(before).withColumn("version", F.lit(0)).unionByName(
        workbooks(after).withColumn("version", F.lit(1)))).filter("version = 1").drop("version")


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """The changes of every version of a manifest against the one before: ``version, file, kind`` and
    the old and new size and time. ``snapshots``: ``version`` (consecutive numbers), ``file, size,
    mtime``. One full outer join on (version, file)."""
    s = snapshots.select("version", "file", "size", "mtime")
    old = s.select((F.col("version") + 1).alias("version"), "file", F.col("size").alias("old_size"),
                   F.col("mtime").alias("old_mtime"), F.lit(True).alias("was"))
    versions = s.select("version").distinct()            # the last one has no successor
    j = s.withColumn("is", F.lit(True)).join(old, ["version", "file"], "full").join(versions, "version", "left_semi")
    same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~same, "changed")
    return j.withColumn("kind", kind).filter("kind is not null").select(
        "version", "file", "kind", "old_size", "size", "old_mtime", "mtime")


def fresh_files(manifest: DataFrame, as_of, hours: int) -> DataFrame:
    """A file is fresh when its age is strictly below ``hours``."""
    limit = F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(hours))
    return manifest.withColumn("fresh", F.col("mtime") > limit)


def retention(manifest: DataFrame, as_of, days: int = fixed.RETENTION_DAYS) -> DataFrame:
    """The deletion plan — workbooks older than ``days`` (reported, not deleted)."""
    limit = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return workbooks(manifest).filter(F.col("mtime") < limit) \
                              .withColumn("action", F.lit("delete"))


def source_status(manifest: DataFrame, catalogue: DataFrame,
                  sample: int = fixed.STATUS_SAMPLE) -> DataFrame:
    """Workbook count, newest file and time, the category count of the
    newest file (all of its catalogue), the first ``sample`` names,
    and whether data is available (a newest file exists) — one row from one
    aggregate and an equi-join on the file name (no cross join)."""
    m = workbooks(manifest)
    head = m.agg(F.count(F.lit(1)).alias("n_files"),
                 F.max_by("file", F.struct("mtime", "file")).alias("file"),
                 F.max("mtime").alias("mtime"))
    newest = catalogue.join(head.select("file"), "file", "left_semi")
    sampled = F.col("r_raw") < fixed.DATA_START_ROW + sample      # at most `sample` names
    per_file = newest.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_categories"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.when(sampled, F.struct("r_raw", "category")))),
            lambda s: s["category"]), ", ").alias("sample_categories"))
    st = head.join(per_file, "file", "left")
    return st.select(
        "n_files", F.col("file").alias("latest_file"), F.col("mtime").alias("latest_mtime"),
        F.coalesce("n_categories", F.lit(0)).alias("n_categories"), "sample_categories",
        F.col("file").isNotNull().alias("data_available"))
