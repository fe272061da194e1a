"""As-of join: for each row, the newest row of another table that was there at its time.

Both sides are put into one order by (group, time) and the last right row seen
so far is carried along. The rows are dealt by ranges of that order, so a group
that holds a third of all rows spreads over many tasks: each task carries
within its range, and what a range begins with comes from a small table of
each range's last right row per group (bounded by ranges x groups in them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str,
              values: list[str], num_partitions: int | None = None) -> DataFrame:
    """``left`` with ``values`` of the right row with equal ``by`` and the
    greatest ``right_time`` not after ``left_time``; nulls if there is none.

    Ties go to the greatest ``values`` in order. Rows of ``left`` with a null
    time have nulls, right rows with a null time count for none; null ``by``
    values are equal to each other.
    """
    spark = left.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    checkpoint_dir(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    found = F.struct(*values)
    keys = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
    group = [f"_by{i}" for i in range(len(by))]
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"))
    b = right.filter(F.col(right_time).isNotNull()).select(
        *keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), found.alias("_found"))
    # A right row comes before left rows of the same time; null times come first, where nothing is found.
    order = ["_t", "_side", "_found"]
    s = (a.unionByName(b, allowMissingColumns=True).repartitionByRange(n, *group, *order)
         .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    last = s.filter("_side = 0").groupBy("_pid", *group).agg(
        F.max(F.struct("_t", "_found")).alias("_last"), F.count("*").alias("_n"))
    groups = s.groupBy("_pid", *group).agg(F.lit(True).alias("_here"))
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"l.{c}")) for c in ["_pid", *group]]
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = (groups.alias("g").join(last.alias("l"), same, "left").select("g._pid", *[f"g.{c}" for c in group], "l._last")
               .withColumn("_carried", F.last("_last._found", ignorenulls=True).over(before)).drop("_last"))
    here = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_seen", F.last("_found", ignorenulls=True).over(here)).filter("_side = 1")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ["_pid", *group]]
    j = s.alias("s").join(carried.alias("c"), same, "left")
    best = F.when(F.col("s._t").isNotNull(), F.coalesce("s._seen", "c._carried"))
    return j.select("s._row", best.alias("_best")).select("_row.*", *[F.col(f"_best.{v}").alias(v) for v in values])
