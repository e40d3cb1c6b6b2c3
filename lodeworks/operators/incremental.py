"""Landing modes as functions from frames to frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.errors import InvalidInput
from lodeworks.plans import watermark


def project(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The asked columns in the asked order; unknown ones are named in the error."""
    if columns is None:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise InvalidInput(f"no column {', '.join(missing)}; columns: {', '.join(df.columns)}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def check_drift(target: DataFrame, source: DataFrame) -> None:
    """Columns must agree in name, order and type."""
    a = [(f.name, f.dataType.simpleString()) for f in target.schema]
    b = [(f.name, f.dataType.simpleString()) for f in source.schema]
    if a != b:
        odd = sorted(set(a) ^ set(b)) or "their order"
        raise InvalidInput(f"schema drift between destination and source: {odd}; run mode='replace'")


def append_delta(source: DataFrame, cursor: str, mark: str | None) -> DataFrame:
    """The rows beyond the watermark; rows with a null cursor never sync."""
    c = F.col(f"`{cursor}`")
    return source.where(watermark.delta(c, mark, source.schema[cursor].dataType, inclusive=False) & c.isNotNull())


def merge_delta(source: DataFrame, cursor: str, mark: str | None) -> DataFrame:
    c = F.col(f"`{cursor}`")
    return source.where(watermark.delta(c, mark, source.schema[cursor].dataType, inclusive=True) & c.isNotNull())


def latest_per_key(df: DataFrame, pk: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: that with the greatest order columns. An aggregate
    with partial combine, so of a hot key only one row of each task is shuffled.
    Ties are broken by the other columns, so the choice is the same on every run."""
    rest = [c for c in df.columns if c not in pk]
    if not rest:
        return df.dropDuplicates(list(pk))
    col = lambda c: F.col(f"`{c}`")
    sortable = [c for c in rest if c not in order and df.schema[c].dataType.typeName() not in ("map", "variant")]
    best = F.max_by(F.struct(*map(col, rest)), F.struct(*map(col, [*order, *sortable])))
    return df.groupBy(*map(col, pk)).agg(best.alias("_best")).select(*[col(c) if c in pk else F.col("_best").getField(c).alias(c) for c in df.columns])


def first_per_key(df: DataFrame, pk: Sequence[str], order: Sequence) -> DataFrame:
    """The same by a window, for orders that mix directions or null placement."""
    w = W.partitionBy(*pk).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def without_keys(target: DataFrame, keys: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Delete by key set."""
    return target.join(keys.select(*pk), list(pk), "left_anti").select(target.columns)


def merge_upsert(target: DataFrame, delta: DataFrame, pk: Sequence[str], cursor: str) -> DataFrame:
    """target with the newest delta row of each key in place of its own; a table
    of nothing but keys only gains the new ones."""
    if not pk:
        raise InvalidInput("merge needs a primary key")
    new = latest_per_key(delta, pk, [cursor] if cursor not in pk else [])
    if set(pk) == set(target.columns):
        return target.unionByName(without_keys(new, target, pk))
    return without_keys(target, new, pk).unionByName(new.select(target.columns))


def sort_for(df: DataFrame, order_by: str | None) -> DataFrame:
    """Rows of each written file in the asked order, without a global sort."""
    if not order_by:
        return df
    cols = [c.strip() for c in order_by.strip("() ").split(",") if c.strip()]
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise InvalidInput(f"order_by names no column: {', '.join(missing)}")
    return df.sortWithinPartitions(*cols)
