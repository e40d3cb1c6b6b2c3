"""The Spark session the engine expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from lodeworks.errors import InvalidInput

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.scheduler.mode": "FAIR",
}


def session(master: str | None = None, app: str = "lodeworks", **extra: str) -> SparkSession:
    """A session with UTC, ANSI casts and adaptive plans; master only where none is set from outside."""
    builder = SparkSession.builder.appName(app).config(map={**SETTINGS, **extra})
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the one that the cluster shares; of this machine only in local mode, where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise InvalidInput("set spark.checkpoint.dir to a folder that all executors share")
    root = f"{shared.rstrip('/')}/{uuid.uuid4().hex}" if shared else "file://" + tempfile.mkdtemp(prefix="lodeworks-")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return root
