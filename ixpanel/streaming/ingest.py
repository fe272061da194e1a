"""Incremental ingest with Structured Streaming.

The original polls a directory in a sleep loop and counts files to notice new
ones. Here a file-source stream over the drop folder does that: its
checkpoint records which files were processed, so a restarted job (or a lost
executor) resumes without re-reading or missing files. ``availableNow`` runs
one pass over what is there (the "run once" mode); a processing-time trigger
(``"30 minutes"``) gives the continuous mode.

Panels are merged by key: of several publications of one (category, date,
adjustment) the newest counts, in whatever order they arrive. A batch writes
the months it touches anew, merged with what the table has for them, under
``rows/version=<batch>/date=<month>``; other months aren't read. Which version
of each month counts is a small table of its own, ``heads/v=<batch>``, written
last: a reader, or a crash before it is complete, sees the table as it was. A
replayed batch starts from the heads before it and writes the same again.

Workbooks go to two sinks, points and unreadable files. A batch counts in both
or in neither: its marker in ``commits`` is written after both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grids as G
from ..sources import workbook as WB

PANEL_SCHEMA = "category string, date string, index double, adjustment string"
PUBLISHED_SCHEMA = PANEL_SCHEMA + ", published timestamp"
KEY = ["category", "date", "adjustment"]
CELL_SCHEMA = WB.CELL_SCHEMA


def _start(source: DataFrame, merge, checkpoint: str, trigger: str):
    w = source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger == "availableNow" else w.trigger(processingTime=trigger)
    return w.start()


def _files(spark: SparkSession, drop_dir: str, schema: str, fmt: str, max_files: int | None, **options) -> DataFrame:
    src = spark.readStream.schema(schema).format(fmt).options(**options)
    if max_files:
        src = src.option("maxFilesPerTrigger", str(max_files))
    return src.load(drop_dir)


def _path(spark: SparkSession, path: str, what: str):
    """List, delete, create or test a path in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if what == "delete":
        return fs.delete(p, True)
    if what == "create":
        return fs.create(p, True).close()
    if what == "exists":
        return fs.exists(p)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _versions(spark: SparkSession, folder: str, below: int | None = None) -> list[int]:
    """Complete versions (``v=<n>``) in order, those below a batch if it is given."""
    found = sorted(int(x[2:]) for x in _path(spark, folder, "list") if x.startswith("v="))
    return [v for v in found if (below is None or v < below) and _path(spark, f"{folder}/v={v}/_SUCCESS", "exists")]


# ---------------------------------------------------------------- a panel merged by key

def _heads(spark: SparkSession, table_dir: str, below: int | None = None) -> DataFrame | None:
    """(date, version): the version that counts for each month; one row a month."""
    found = _versions(spark, f"{table_dir}/heads", below)
    return spark.read.schema("date string, version int").parquet(f"{table_dir}/heads/v={found[-1]}") if found else None


def _rows_of(spark: SparkSession, table_dir: str, heads: DataFrame) -> DataFrame:
    """The rows of the months in ``heads`` (one row a month): their folders alone are listed and read."""
    folders = [f"{table_dir}/rows/version={r.version}/date={r.date}" for r in heads.collect()]
    schema = "category string, adjustment string, index double, published timestamp, source string, version int, date string"
    if not folders:
        rows = spark.createDataFrame([], schema)
    else:
        rows = spark.read.schema(schema).option("basePath", f"{table_dir}/rows").parquet(*folders)
    return rows.select(*KEY, "index", "published", "source")


def newest(rows: DataFrame) -> DataFrame:
    """One row per key: that of the newest publication (ties: the greatest file name, then value)."""
    best = F.max(F.struct("published", "source", "index")).alias("best")
    return rows.groupBy(*KEY).agg(best).select(*KEY, "best.index", "best.published", "best.source")


def upsert(batch: DataFrame, batch_id: int, table_dir: str) -> None:
    """Merge published rows into the table at ``table_dir``. Rows whose date names no month (``YYYY-MM``)
    belong to none and are left out."""
    spark = batch.sparkSession
    batch = batch.filter(F.col("date").rlike("^[0-9]{4}-[0-9]{2}$")).select(*KEY, "index", "published", "source").persist()
    try:
        touched = batch.select("date").distinct()
        before = _heads(spark, table_dir, batch_id)
        known = batch if before is None else batch.unionByName(
            _rows_of(spark, table_dir, before.join(touched, "date", "left_semi")))
        newest(known).write.partitionBy("date").mode("overwrite").parquet(f"{table_dir}/rows/version={batch_id}")
        heads = touched.select("date", F.lit(batch_id).cast("int").alias("version"))
        if before is not None:
            heads = heads.unionByName(before.join(touched, "date", "left_anti"))
        heads.coalesce(1).write.mode("overwrite").parquet(f"{table_dir}/heads/v={batch_id}")    # one row a month
    finally:
        batch.unpersist()


def read_table(spark: SparkSession, table_dir: str) -> DataFrame:
    """The panel as of the newest complete version."""
    heads = _heads(spark, table_dir)
    if heads is None:
        return spark.createDataFrame([], PANEL_SCHEMA)
    return _rows_of(spark, table_dir, heads).select("category", "date", "index", "adjustment")


def vacuum(spark: SparkSession, table_dir: str) -> None:
    """Remove heads before the newest, and months of versions that it doesn't name. For times
    without readers of older versions."""
    found = _versions(spark, f"{table_dir}/heads")
    if not found:
        return
    used = {(r.version, r.date) for r in _heads(spark, table_dir).collect()}        # one row a month
    for name in _path(spark, f"{table_dir}/rows", "list"):
        version = int(name.removeprefix("version="))
        months = [m for m in _path(spark, f"{table_dir}/rows/{name}", "list") if m.startswith("date=")]
        old = [m for m in months if (version, m[5:]) not in used]
        if version <= found[-1]:            # later ones belong to a batch that is being written
            for m in old:
                _path(spark, f"{table_dir}/rows/{name}/{m}", "delete")
    for v in found[:-1]:
        _path(spark, f"{table_dir}/heads/v={v}", "delete")


def _published(rows: DataFrame) -> DataFrame:
    """Rows of drop files with when and where they were published: by themselves, or by their file."""
    when = F.col("published") if "published" in rows.columns else F.col("_metadata.file_modification_time")
    return rows.select(*KEY, "index", when.alias("published"), F.col("_metadata.file_name").alias("source"))


def stream_ingest(spark: SparkSession, drop_dir: str, table_dir: str, checkpoint: str,
                  schema: str = PANEL_SCHEMA, fmt: str = "parquet",
                  trigger: str = "availableNow", max_files_per_trigger: int | None = None):
    """Merge every new file of ``drop_dir`` into the table at ``table_dir``."""
    src = _published(_files(spark, drop_dir, schema, fmt, max_files_per_trigger))
    return _start(src, lambda batch, b: upsert(batch, b, table_dir), checkpoint, trigger)


def stream_latest(spark: SparkSession, drop_dir: str, table_dir: str, latest_dir: str,
                  checkpoint: str, n: int = 2, schema: str = PANEL_SCHEMA,
                  trigger: str = "availableNow", max_files_per_trigger: int | None = None):
    """After each new batch is merged, the latest ``n`` months become the
    answer; only these are read. Each answer is a folder of its own,
    ``latest_dir/v=<batch>``, and counts once it is complete (``read_latest``)."""
    src = _published(_files(spark, drop_dir, schema, "parquet", max_files_per_trigger))

    def merge(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        upsert(batch, batch_id, table_dir)
        top = _heads(s, table_dir, batch_id + 1).orderBy(F.desc("date")).limit(n)
        _rows_of(s, table_dir, top).select("category", "date", "index", "adjustment") \
            .write.mode("overwrite").parquet(f"{latest_dir}/v={batch_id}")
        for old in _versions(s, latest_dir, batch_id)[:-1]:
            _path(s, f"{latest_dir}/v={old}", "delete")

    return _start(src, merge, checkpoint, trigger)


def read_latest(spark: SparkSession, latest_dir: str) -> DataFrame:
    """The newest complete answer of ``stream_latest``."""
    return spark.read.parquet(f"{latest_dir}/v={_versions(spark, latest_dir)[-1]}")


# ---------------------------------------------------------------- workbooks: two sinks, one marker

def _sink(rows: DataFrame, folder: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def stream_workbooks(spark: SparkSession, drop_dir: str, out_dir: str, checkpoint: str,
                     ticker: str = "cpi", trigger: str = "availableNow",
                     max_files_per_trigger: int | None = None, fmt: str = "binaryFile"):
    """T1 over workbooks: the points of every new workbook in ``drop_dir`` (three layouts, G8) go to
    ``out_dir/points``, those that can't be read to ``out_dir/unreadable`` (file, problem).

    ``fmt``: ``binaryFile`` for ``*.xlsx`` files, decoded one per row; ``parquet`` for files of cells,
    a workbook's cells in one file (an unreadable workbook is one row of kind ``error``)."""
    if fmt == "binaryFile":
        src = _files(spark, drop_dir, "path string, modificationTime timestamp, length long, content binary", fmt,
                     max_files_per_trigger, pathGlobFilter="*.xlsx")
    else:
        src = _files(spark, drop_dir, CELL_SCHEMA, fmt, max_files_per_trigger)

    def merge(batch: DataFrame, batch_id: int) -> None:
        cells = (WB.decoded(batch) if fmt == "binaryFile" else batch).persist()     # decoded once per batch
        bad = F.col("kind") == WB.ERROR
        try:
            _sink(G.union_layouts(cells.filter(~bad), ticker), f"{out_dir}/points", batch_id)
            _sink(cells.filter(bad).select("file", F.col("raw").alias("problem")), f"{out_dir}/unreadable", batch_id)
            _path(batch.sparkSession, f"{out_dir}/commits/{batch_id}", "create")
        finally:
            cells.unpersist()                            # a long-running stream keeps no old batches

    return _start(src, merge, checkpoint, trigger)


def read_committed(spark: SparkSession, out_dir: str, sink: str, schema: str | None = None) -> DataFrame:
    """``points`` or ``unreadable`` of the batches that count."""
    paths = [f"{out_dir}/{sink}/batch={b}" for b in _path(spark, f"{out_dir}/commits", "list") if b.isdigit()]
    if not paths and schema:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(*paths)
