"""Connected components by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.llm.common import landed
from lodeworks.llm.textbytes import frugal


def _forest(batches):
    """Replace a partition's edges by stars to the least node of each local component."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (whole-number columns a and b): root is
    the least node of its component. Loops and repeated edges are fine, null
    ends are dropped, and no edges give no rows.

    Every round halves the depth of what is left; each is written to the shared
    folder, so a lost executor repeats at most one round.
    """
    e = edges.where("a is not null and b is not null")
    loops = e.where("a = b").select(F.col("a").alias("node"))
    e = e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = landed(e.mapInArrow(frugal(_forest), "u bigint, v bigint"), "forest")
    mark = lambda d: d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = mark(e)
    while last[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = F.least(F.min("v").over(W.partitionBy("u")), F.col("u"))
        large = both.select("u", "v", low.alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.select("u", "v", F.min("v").over(W.partitionBy("u")).alias("m"))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        e = landed(small, "stars")
        now = mark(e)
        if tuple(now) == tuple(last):
            break
        last = now
    star = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    rest = loops.distinct().join(star.unionByName(roots).select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    return star.unionByName(roots).unionByName(rest)


def union_find(pairs: np.ndarray, n: int) -> np.ndarray:
    """The least member of each of n items' components (in memory, for one bucket)."""
    label = np.arange(n)
    if not len(pairs):
        return label
    a, b = pairs[:, 0], pairs[:, 1]
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new
