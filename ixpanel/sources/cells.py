"""The stored cell table (S1, S2): cells of many workbooks as Parquet.

Ingest writes the cells once; every grid operator then reads the table. It is
partitioned by ``part``, a hash of the file name, rather than by the name
itself: millions of workbooks would be millions of folders, while the number
of parts is a parameter. Within a part rows are sorted by file, sheet and row,
so the minima and maxima of Parquet's row groups skip other files and, for
header searches, other rows. A question about some files (the newest one, those
of a request) joins on (part, file), and dynamic partition pruning reads their
parts alone.

Spark deals the rows by part when it writes and splits parts that are much
larger than others (``REBALANCE``), so no task writes a part of any size whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64


def part_of(file, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(parts)).cast("int")


def write_cells(cells: DataFrame, path: str, parts: int = PARTS, mode: str = "overwrite") -> None:
    """Store cells; ``mode="append"`` adds further workbooks."""
    (cells.withColumn("part", part_of("file", parts)).hint("rebalance", "part")
     .sortWithinPartitions("part", "file", "sheet_pos", "r_raw", "c")
     .write.partitionBy("part").mode(mode).parquet(path))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """All stored cells, with their part."""
    return spark.read.schema("file string, sheet string, sheet_pos int, r_raw int, r int, c int, raw string, "
                             "kind string, part int").parquet(path)


def of_files(cells: DataFrame, files: DataFrame, parts: int = PARTS) -> DataFrame:
    """The cells of ``files`` (file): only their parts are read."""
    wanted = files.select("file", part_of("file", parts).alias("part"))
    return cells.join(wanted, ["part", "file"], "left_semi")
