"""Sharding by histogram sort.

Balanced, globally ordered shards: the driver keeps a bracket of keys around
every wanted cut, each round counts the exact bytes at or below candidate keys
in all partitions, and the brackets shrink until every cut meets the tolerance.
Only then do the rows move, once, straight to their shard.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import free, landed, make_room

NULL_KEY = -(1 << 63)


def below(key: Column, cuts: list[int] | Column, most: int | None = None) -> Column:
    """How many of the ascending cuts lie below key: a binary search inside the JVM.
    cuts may be a column of arrays with at most `most` elements."""
    if isinstance(cuts, list):
        most, count = len(cuts), F.lit(len(cuts))
        table = F.array(*map(F.lit, cuts)) if most < 64 else F.from_json(F.lit(str(cuts)), "array<bigint>")
    else:
        table, count = cuts, F.size(cuts)
    if not most:
        return F.lit(0)
    steps = [1 << i for i in range(most.bit_length())][::-1]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when((at + step <= count) & (F.try_element_at(table, at + step) < key), at + step).otherwise(at),
    )


def find_cuts(slim: DataFrame, shards: int, tolerance: float, probes: int, stride: int = 1) -> list[int]:
    """Cut keys, of every stride-th shard: shard i ends with the key cuts[i] (slim has columns k and b); where
    one key holds several cuts, the shards between them are empty.

    Cut i is a key whose cumulative bytes are within tolerance (a share of a
    mean shard) of i/shards of all bytes, or, where a single key weighs more,
    the least key that reaches the target. tolerance 0 gives the unique exact
    cuts. Driver state is a few numbers a shard, whatever the number of rows.
    """
    low, high, total = slim.agg(F.min("k"), F.max("k"), F.sum("b")).first()
    if low is None or not total or shards < 2:
        return []
    slack = tolerance * total / shards
    targets = [-(-i * total // shards) for i in range(stride, shards, stride)]
    bracket = [[low - 1, 0, high, total] for _ in targets]
    cuts: list[int | None] = [None] * len(targets)
    while True:
        ask: set[int] = set()
        for i, (lo, at_lo, hi, at_hi) in enumerate(bracket):
            if cuts[i] is not None:
                continue
            if hi - lo == 1 or at_hi - targets[i] <= slack:
                cuts[i] = hi
            elif lo > low - 1 and targets[i] - at_lo <= slack:
                cuts[i] = lo
            else:
                n = min(probes, hi - lo - 1)
                ask.update(lo + (hi - lo) * j // (n + 1) for j in range(1, n + 1))
        keys = sorted(k for k in ask if k >= low)
        if not keys:
            if all(c is not None for c in cuts):
                return sorted(cuts)
            keys = [low]
        found = {r[0]: r[1] for r in slim.groupBy(below(F.col("k"), keys).alias("cell")).agg(F.sum("b")).collect()}
        run, cum = 0, []
        for cell in range(len(keys)):
            run += found.get(cell, 0) or 0
            cum.append(run)
        for i, (lo, at_lo, hi, at_hi) in enumerate(bracket):
            if cuts[i] is not None:
                continue
            j = bisect.bisect_left(cum, targets[i])
            if j < len(keys) and lo < keys[j] < hi:
                bracket[i][2:] = keys[j], cum[j]
            if j and lo < keys[j - 1] < hi:
                bracket[i][:2] = keys[j - 1], cum[j - 1]


def fine_cuts(slim: DataFrame, coarse: list[int], shards: int, stride: int) -> DataFrame:
    """cell, cuts: the exact cuts between coarse ones, counted where a cell's keys are.

    A cell has stride shards, so the driver knows of the coarse cuts only."""
    cells = slim.withColumn("cell", below(F.col("k"), coarse).cast("int"))
    before, run = {}, 0
    sizes = {r[0]: r[1] for r in cells.groupBy("cell").agg(F.sum("b")).collect()}
    for cell in sorted(sizes):
        before[cell] = run
        run += sizes[cell]
    total = run

    def count(t: pa.Table) -> pa.Table:
        cell = t.column("cell")[0].as_py()
        k, b = t.column("k").to_numpy(), t.column("b").to_numpy()
        by = np.argsort(k, kind="stable")
        k, upto = k[by], np.cumsum(b[by])
        targets = [-(-i * total // shards) - before[cell] for i in range(cell * stride + 1, min(shards, (cell + 1) * stride))]
        cuts = [int(k[np.searchsorted(upto, x)]) if x > 0 else NULL_KEY for x in targets if x <= int(upto[-1])]
        # a target that the keys before already reach ends before this cell: it lies below all of its keys
        return pa.table({"cell": pa.array([cell], pa.int32()), "less": pa.array([sum(x <= 0 for x in targets)], pa.int32()), "cuts": pa.array([[c for c, x in zip(cuts, targets) if x > 0]], pa.list_(pa.int64()))})

    return cells.groupBy("cell").applyInArrow(count, "cell int, less int, cuts array<bigint>")


def histogram_sort(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shard_bytes: int = 64 << 20,
    tolerance: float = 0.0,
    probes: int = 63,
    coarse: int = 1024,
) -> DataFrame:
    """Docs with a column `shard`, moved into one sorted partition for each shard.

    key: a whole-number column that orders the result. shard_bytes: the mean
    size of a shard in UTF-8 bytes of text; the number of shards follows from
    the data. tolerance: how far a cut may miss, as a share of a mean shard.
    Nulls: a null key sorts first, as the least possible key; a null text weighs
    nothing. Rows with one key stay together, in any order, so a shard is larger
    than asked only by its last key. Texts of any length weigh what they hold.
    An empty table gives an empty result. A column named `shard` is kept as
    `shard_in`; all columns of docs stay. coarse: cuts that the driver refines at
    a time; where there are more, the exact cuts between them are counted in the
    executors, each cell by itself.
    """
    docs = make_room(docs, ["shard"])
    k = F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(NULL_KEY))
    slim = landed(docs.select(k.alias("k"), F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("bigint").alias("b")), "keys")
    total = slim.agg(F.sum("b")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    stride = -(-shards // coarse)
    cuts = find_cuts(slim, shards, tolerance, probes, stride)
    tie = free(docs.columns, "_key")
    out, shard = docs, below(k, cuts)
    if stride > 1:
        cell, less, inner = (free(docs.columns, c) for c in ("_cell", "_less", "_cuts"))
        fine = landed(fine_cuts(slim, cuts, shards, stride), "cuts").toDF(cell, less, inner)
        out = docs.withColumn(cell, shard.cast("int")).join(fine, cell)
        shard = F.col(cell) * stride + F.col(less) + below(k, F.col(inner), stride)
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns], shard.cast("int").alias("shard"), k.alias(tie))
    return out.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", tie).drop(tie)


def sharding_sql(shard_bytes: int) -> str:
    return f"""
with d as (select *, coalesce(octet_length(encode(text)), 0)::hugeint as b from documents),
t as (select sum(b)::hugeint as total, greatest(1, ceil(sum(b) / {shard_bytes}.0))::hugeint as n from d),
c as (select *, coalesce(sum(b) over (order by doc_id nulls first range between unbounded preceding and current row), 0) - sum(b) over (partition by doc_id) as before from d)
select doc_id, text, lang, source, n_chars,
       case when total = 0 then 0 else least(n - 1, before * n // total) end::int as shard
from c, t
"""
