"""Plain files in an object store: whole tables only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodeworks.errors import InvalidInput
from lodeworks.plans.types import stringify_exotic, to_sink_schema


class ObjectStore:
    """<root>/<table>.csv.gz (one gzip file) or <root>/<table>.parquet (a folder of zstd parts)."""

    kind = "objects"
    modes = ("replace",)

    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet") -> None:
        if fmt not in ("parquet", "csv"):
            raise InvalidInput(f"no object format {fmt!r}")
        self.spark, self.root, self.fmt, self.url = spark, root.rstrip("/"), fmt, f"{fmt}://{root}"

    def replace(self, name: str, df: DataFrame) -> int:
        """Write aside, then rename; a table without rows replaces nothing."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        fs = path(self.root).getFileSystem(conf)
        aside = f"{self.root}/.{name}-{uuid.uuid4().hex}"
        seen = Observation()
        out = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        if self.fmt == "parquet":
            to_sink_schema(out, "parquet").write.option("compression", "zstd").parquet(aside)
        else:
            stringify_exotic(out).coalesce(1).write.option("compression", "gzip").option("header", True).option("nullValue", "").option("emptyValue", '""').csv(aside)
        rows = int(seen.get["rows"])
        final = f"{self.root}/{name}." + ("parquet" if self.fmt == "parquet" else "csv.gz")
        if rows:
            new = path(aside)
            if self.fmt == "csv":
                new = next(s.getPath() for s in fs.listStatus(new) if s.getPath().getName().startswith("part-"))
            if fs.exists(path(final)):
                fs.delete(path(final), True)
            fs.rename(new, path(final))
        fs.delete(path(aside), True)
        return rows
