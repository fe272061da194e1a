"""Row numbers within groups that stay balanced when one group is huge.

``Window.partitionBy(g).orderBy(k)`` puts a whole group into one task. When
one group may hold a third of all rows, that task becomes the job. Here the
rows are range-partitioned and sorted on ``(g, k)`` instead, so a hot group is
spread over many partitions in order. The sorted rows are numbered as they
stand; a small table of each (partition, group)'s first number and count turns
these into positions. That table's window per group spans at most the number
of partitions — bounded, whatever the skew. Rows are shuffled once for the
order and once for the join with that table (not at all if it is small).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def rank_within(df: DataFrame, group_cols: list[str], order_cols: list[Column],
                num_partitions: int | None = None, name: str = "rank") -> DataFrame:
    """Add ``name`` = 1-based position of each row in its group by ``order_cols``.

    ``order_cols`` must make rows unique within a group (end with a unique
    tie-breaker), so the numbering is deterministic.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group_cols] + list(order_cols)
    # Range bounds are sampled per job, so the partition id is fixed once by a
    # reliable checkpoint (shared checkpoint folder); every later step reads
    # the same materialised rows, also after an executor loss.
    checkpoint_dir(spark)
    s = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_id", F.monotonically_increasing_id()).checkpoint(eager=True))
    cnt = s.groupBy("_pid", *group_cols).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_pid") \
                   .rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1 - F.col("_first")) \
             .drop("_n", "_first")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}")) for c in group_cols]
    return (s.alias("s").join(off.alias("o"), [F.col("s._pid") == F.col("o._pid"), *same])
            .select("s.*", (F.col("s._id") + F.col("o._off")).cast("int").alias(name))
            .drop("_pid", "_id"))
