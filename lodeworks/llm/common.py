"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only in local mode, where the session leaves it unset (as in tests), a folder
    of this machine takes its place; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.TemporaryDirectory(prefix="lodeworks-"))
        atexit.register(_OWN[0].cleanup)
    return "file://" + _OWN[0].name


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    This cuts the lineage (a lost executor costs nothing that came before), and
    the file sizes tell Catalyst whether a later join may broadcast the table:
    under spark.sql.autoBroadcastJoinThreshold it does, beyond it shuffles. The
    table goes with the application, or earlier by release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodeworks/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths().append((spark, path))
    at, fs = _file(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_OF_THREAD = threading.local()


def _paths() -> list:
    """What this thread has landed: jobs in other threads keep lists of their own."""
    return _OF_THREAD.__dict__.setdefault("paths", [])


def grown(df: DataFrame) -> DataFrame:
    """Mark a join side that grows with the corpus: it is hash-partitioned along with
    the other side at every size, never sent to all executors. Each partition of
    it is held as a hash table, so the larger side needs no sort."""
    return df.hint("shuffle_hash")


def mark() -> int:
    """A place in the list of written tables, for release()."""
    return len(_paths())


def release(since: int, until: int) -> None:
    """Delete the tables that landed() wrote between two marks; call it when nothing reads them any more."""
    for i in range(since, until):
        spark, path = _paths()[i]
        at, fs = _file(spark, path)
        fs.delete(at, True)


def free(names: Iterable[str], wanted: str) -> str:
    """wanted, with underscores behind it until no column (in any case) has the name."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def make_room(df: DataFrame, outputs: Iterable[str]) -> DataFrame:
    """Rename columns of df that an operator's outputs would clash with, to <name>_in."""
    out = {o.lower() for o in outputs}
    for c in df.columns:
        if c.lower() in out:
            df = df.withColumnRenamed(c, free(df.columns, c + "_in"))
    return df


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Select only the wanted columns, under the operator's own names."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in wanted.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
