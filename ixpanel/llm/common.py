"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ixpanel.session import checkpoint_dir

# Rows of one Arrow batch handed to Python: whole texts are long, so fewer than Spark's 10,000.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def prepare(spark: SparkSession) -> None:
    """Arrow batches small enough for whole texts; a checkpoint folder all executors share."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    checkpoint_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared checkpoint folder and read from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(c: Column | str = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def field_of(df: DataFrame, name: str) -> str:
    """DDL of one column, for the schema of an Arrow function that passes it through."""
    return f"`{name}` {df.schema[name].dataType.simpleString()}"
