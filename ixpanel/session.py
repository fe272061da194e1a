"""Spark session defaults for the engine.

Everything here is plain Spark configuration. On a cluster the session is
normally created by the platform; ``configure`` only fills settings that are
unset, and ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the session
instead of inventing a machine-local folder.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings the engine relies on. AQE re-plans joins from measured sizes (this is
# the size check behind every broadcast we do not hint explicitly), coalesces
# small shuffle partitions and splits skewed join partitions.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Plans are built from many small expressions; finding the call site of each takes most of that time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "ixpanel",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply runtime SQL defaults that are not already set on ``spark``."""
    for k in ("spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled",
              "spark.sql.session.timeZone"):
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, DEFAULTS[k])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and written intermediate tables.

    Uses ``spark.checkpoint.dir`` as configured for the cluster. Only when it
    is unset and the master is local (tests) a scratch folder is created and
    registered; elsewhere executors would write to disks of their own, so an
    unset folder is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not re.match(r"local(\[[^\]]*\])?$", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder all executors share (master {master})")
        d = tempfile.mkdtemp(prefix="ixpanel-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for a written intermediate table under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), name)


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Remove a folder made under ``scratch_path``, in whatever store it is."""
    if not path.startswith(checkpoint_dir(spark)):
        raise ValueError(f"{path} is no scratch folder")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
