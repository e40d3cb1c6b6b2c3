"""read(): a table as a lazy frame, and the ways to take it out of Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodeworks.operators.incremental import project


class Reader:
    """A lazy table. Unlike a stream it may be used any number of times."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self) -> list[tuple[str, str, bool]]:
        """(name, type, nullable), without reading rows."""
        return [(f.name, f.dataType.simpleString(), f.nullable) for f in self.df.schema]

    def lazy(self) -> DataFrame:
        return self.df

    def to_arrow(self) -> pa.Table:
        return self.df.toArrow()

    def to_pandas(self) -> pd.DataFrame:
        return self.df.toPandas()

    def batches(self, rows: int = 65_536) -> Iterator[pa.RecordBatch]:
        """Arrow batches, a partition at a time, so the driver never holds the whole table."""
        schema = self.df.schema
        buffer: list = []
        for row in self.df.toLocalIterator(prefetchPartitions=True):
            buffer.append(row)
            if len(buffer) == rows:
                yield self._batch(buffer, schema)
                buffer = []
        if buffer:
            yield self._batch(buffer, schema)

    @staticmethod
    def _batch(rows: list, schema) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        cols = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
        return pa.RecordBatch.from_arrays(cols, schema=arrow)

    def __arrow_c_stream__(self, requested_schema=None):
        return self.to_arrow().__arrow_c_stream__(requested_schema)

    def to_parquet(self, path: str) -> int:
        """Write zstd Parquet; returns the number of rows."""
        seen = Observation()
        self.df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", "zstd").parquet(path)
        return int(seen.get["rows"])


def reader(df: DataFrame, columns: list[str] | None) -> Reader:
    return Reader(project(df, columns))
