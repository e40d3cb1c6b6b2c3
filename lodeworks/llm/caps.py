"""Embedding near-dedup by spherical-cap filters.

A random product code gives the directions: a vector's axes are rotated at
random and cut into blocks, each block has a list of code words, and a direction
takes one word of every block. List decoding finds all directions that a vector
exceeds, word by word, without looking at the others. Vectors that share a
direction meet in its cap, and pairs are verified.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import landed
from lodeworks.llm.components import components, union_find
from lodeworks.llm.topk import vectors
from lodeworks.llm.textbytes import frugal

PRODUCTION = dict(threshold=0.95, caps=12, cap_rows=64, seed=17)
#: Bytes of vectors (float32) that a task compares at a time: a larger cap is cut into parts, each pair of parts a task's work.
PART_BYTES = 8 << 20
NO_ID = -(1 << 63)
LEAST = 4
RECALL = 0.96


class ProductCode:
    """directions = words ** blocks unit vectors, of which a vector exceeds about `caps`, and `least` at least.

    alpha and least are set by decoding random pairs at the threshold: sums of
    block products have lighter tails than the normal, and what two vectors
    need to meet grows with the number of directions.
    """

    def __init__(self, dim: int, rows: int, caps: int, cap_rows: int, seed: int, threshold: float = 0.95) -> None:
        wanted = max(64.0, rows * caps / cap_rows)
        self.blocks = min(max(1, dim // 4), max(2, int(np.ceil(np.log(wanted) / np.log(256))))) if dim > 1 else 1
        self.words = max(2, int(round(wanted ** (1 / self.blocks))))
        rng = np.random.default_rng(seed + dim)
        self.turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.cuts = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.code = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            c = rng.normal(size=(self.words, b - a))
            self.code.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(self.blocks))
        share = min(0.5, caps / self.words**self.blocks)
        self.alpha = NormalDist().inv_cdf(1 - share) / np.sqrt(dim)
        self.least = LEAST
        if dim > 1:
            self._tune(rng, dim, caps, min(max(threshold, -1.0), 1.0))

    def _tune(self, rng: np.random.Generator, dim: int, caps: int, cosine: float, pairs: int = 2000) -> None:
        """Lower alpha until a vector exceeds `caps` directions on average, then raise
        least until RECALL of the pairs at this cosine share one.

        The axes are turned at random, so any pair of a table does as a random one.
        """
        x, y = rng.normal(size=(2, pairs, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        every = self.words**self.blocks

        def marks(unit: np.ndarray) -> np.ndarray:
            parts = [(lo, *self.decode(unit[lo : lo + 250])) for lo in range(0, pairs, 250)]
            return np.concatenate([(row + lo) * every + direction for lo, row, direction in parts])

        while self.alpha > 0 and len(marks(x)) < min(caps, every / 2) * pairs:
            self.alpha -= 0.01 / np.sqrt(dim)
        while self.least < every and len(np.unique(np.intersect1d(marks(x), marks(y)) // every)) < RECALL * pairs:
            self.least = min(every, self.least + max(1, self.least // 4))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) for every direction whose product with the row reaches alpha.

        Block by block: a prefix of words lives on only if the best words of the
        remaining blocks could still lift it to alpha. A row that reaches alpha in
        fewer than `least` directions gets its `least` best ones.
        """
        x = unit @ self.turn
        score = [x[:, a:b] @ c.T for (a, b), c in zip(zip(self.cuts[:-1], self.cuts[1:]), self.code)]
        best = [s.max(axis=1) for s in score]
        rest = np.zeros((self.blocks + 1, len(x)))
        for i in range(self.blocks - 1, -1, -1):
            rest[i] = rest[i + 1] + best[i]
        row, direction, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        need = np.full(len(x), self.alpha - 1e-12)
        for i, s in enumerate(score):
            keep = total[:, None] + s[row] + rest[i + 1][row][:, None] >= need[row][:, None]
            r, w = np.nonzero(keep)
            total, direction, row = total[r] + s[row[r], w], direction[r] * self.words + w, row[r]
        few = np.flatnonzero(np.bincount(row, minlength=len(x)) < self.least)
        if len(few):
            keep = ~np.isin(row, few)
            at, best_d = self._best(few, score)
            row, direction = np.concatenate([row[keep], at]), np.concatenate([direction[keep], best_d])
        return row, direction

    def _best(self, rows: np.ndarray, score: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The `least` best directions of some rows.

        The best sums come from the best of each block: the i-th best prefix with
        the j-th best word has i * j - 1 others above it.
        """
        total, direction = np.zeros((len(rows), 1)), np.zeros((len(rows), 1), np.int64)
        for s in score:
            w = np.argsort(-s[rows], axis=1, kind="stable")[:, : self.least]
            i, j = np.nonzero(np.outer(np.arange(1, total.shape[1] + 1), np.arange(1, w.shape[1] + 1)) <= self.least)
            total = total[:, i] + np.take_along_axis(s[rows], w, 1)[:, j]
            direction = direction[:, i] * self.words + w[:, j]
            top = np.argsort(-total, axis=1, kind="stable")[:, : self.least]
            total, direction = np.take_along_axis(total, top, 1), np.take_along_axis(direction, top, 1)
        return np.repeat(rows, direction.shape[1]), direction.ravel()


def edges_of(names: np.ndarray, unit: np.ndarray, threshold: float, split: int = 0) -> np.ndarray:
    """A spanning forest (a, b) of the pairs with cosine at or above threshold: of all
    pairs, or with split, of those between the first `split` vectors and the rest.

    Every pair is compared; only pairs that aren't connected yet are looked at
    further, so a dense group costs no more than its products.
    """
    n = len(names)
    label = np.arange(n)
    upto, start = (split, split) if split else (n, 0)
    step = max(1, 2_000_000 // max(1, n - start))
    for lo in range(0, upto, step):
        hi = min(upto, lo + step)
        near = unit[lo:hi] @ unit[start:].T >= threshold
        near &= label[lo:hi, None] != label[None, start:]
        if near.any():
            r, c = np.nonzero(near)
            label = union_find(np.stack([label[r + lo], label[c + start]], axis=1), n)[label]
    odd = np.flatnonzero(label != np.arange(n))
    return np.stack([names[label[odd]], names[odd]], axis=1)


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, caps: int = 12, cap_rows: int = 64, seed: int = 17, part_bytes: int = PART_BYTES) -> DataFrame:
    """vec_id, keep_id: a row for each vector with a near duplicate of a smaller id;
    keep_id is the smallest of its group (connected components of cosine >= threshold).

    caps: directions a vector exceeds, on average, or more if it takes more for
    RECALL of the pairs at the threshold to meet; cap_rows: mean vectors in a
    cap at `caps` directions a vector, whatever the table's size: the number of
    directions grows with it.
    Vectors equal element by element are one node from the start. Every vector
    is searched, and all pairs in a cap are compared, those of a cap above
    part_bytes in several tasks.
    Nulls: a null key sorts first, gives a null id, and null keys count as one
    id; vectors that are null, empty, zero, or have a null, NaN or infinite
    element are in no group; only vectors of one length meet. Repeated rows
    with one key count as one. An empty table gives no rows. Vectors may be of
    any length. Other columns are ignored, whatever their names.
    """
    v = F.col(f"`{vector}`").cast("array<float>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    rows = landed(rows.select(F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(NO_ID)).alias("k"), F.xxhash64(v).alias("node"), v.alias("v")), "rows")
    nodes = landed(rows.groupBy("node").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")), "nodes")
    parts = []
    for dim, count in sorted((r[0], r[1]) for r in nodes.groupBy(F.size("v")).count().collect()):
        parts.append(_edges(nodes.where(F.size("v") == dim), dim, count, threshold, caps, cap_rows, seed, part_bytes))
    spark = table.sparkSession
    edges = spark.createDataFrame([], "a bigint, b bigint")
    for p in parts:
        edges = edges.unionByName(p)
    labels = components(landed(edges.distinct(), "edges"))
    rooted = nodes.select("node", "k", "n").join(landed(labels, "labels"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = rooted.groupBy("root").agg(F.min("k").alias("keep"), F.sum("n").alias("m")).where("m > 1")
    heads = landed(rooted.join(heads, "root").select("node", "keep"), "heads")
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.select("k", "node").join(heads, "node").where("k <> keep").select(shown("k").alias("vec_id"), shown("keep").alias("keep_id"))


def _edges(nodes: DataFrame, dim: int, count: int, threshold: float, caps: int, cap_rows: int, seed: int, part_bytes: int) -> DataFrame:
    code = ProductCode(dim, count, caps, cap_rows, seed, threshold)
    step = max(1, min(1024, (1 << 22) // (dim * max(code.least, caps))))

    def filters(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                x = vectors(part, "v", dim).astype(np.float64)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                row, direction = code.decode(unit)
                flat = unit.astype(np.float32)[row].ravel()
                off = np.arange(len(row) + 1, dtype=np.int32) * dim
                yield pa.RecordBatch.from_arrays([pa.array(direction), pa.array(part.column("node").to_numpy()[row]), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["cap", "node", "u"])

    def counts(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                x = vectors(batch.slice(lo, step), "v", dim).astype(np.float64)
                cap, n = np.unique(code.decode(x / np.linalg.norm(x, axis=1, keepdims=True))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cap), pa.array(n)], ["cap", "n"])

    # caps that one task should not compare alone: few, unless the vectors crowd
    most = max(2, part_bytes // (4 * dim))
    crowded = nodes.select("v").mapInArrow(frugal(counts), "cap bigint, n bigint").groupBy("cap").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    crowded = landed(crowded.select("cap", F.ceil(F.col("n") / most).cast("int").alias("parts")), "crowded")
    met = nodes.select("node", "v").mapInArrow(frugal(filters), "cap bigint, node bigint, u array<float>").join(crowded, "cap", "left")
    part = F.pmod(F.xxhash64("node", F.lit(seed)), F.col("parts")).cast("int")
    met = met.withColumn("mine", F.coalesce(part, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    place = ["cap", "lo", "hi"]
    met = met.select("cap", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "u").repartition(*place).sortWithinPartitions(*place, "mine")

    def verify(batches):
        held: list[pa.RecordBatch] = []
        now = None

        def settle():
            t = pa.Table.from_batches(held)
            if t.num_rows < 2:
                return None
            mine = t.column("mine").to_numpy()
            split = 0 if now[1] == now[2] else int(np.searchsorted(mine, now[2]))
            if now[1] != now[2] and split in (0, len(mine)):
                return None
            e = edges_of(t.column("node").to_numpy(), vectors(t.combine_chunks().to_batches()[0], "u", dim).astype(np.float64), threshold, split)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"]) if len(e) else None

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in place], axis=1)
            cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            for a, b in zip(cut, np.append(cut[1:], len(key))):
                at = tuple(key[a].tolist())
                if now is not None and at != now:
                    if (out := settle()) is not None:
                        yield out
                    held = []
                now = at
                held.append(batch.slice(a, b - a))
        if held and (out := settle()) is not None:
            yield out

    return met.mapInArrow(frugal(verify), "a bigint, b bigint")


def caps_sql(threshold: float = 0.95) -> str:
    """All pairs, and the least id of each component."""
    return f"""
with recursive e as (select vec_id, embedding::double[] as v from embeddings where embedding is not null and len(embedding) > 0),
p as (select a.vec_id as a, b.vec_id as b from e a join e b on a.vec_id <> b.vec_id where list_cosine_similarity(a.v, b.v) >= {threshold}),
r(node, root) as (select a, least(a, b) from p union select p.b, r.root from r join p on p.a = r.node where r.root < p.b)
select node as vec_id, min(root) as keep_id from r group by node having min(root) < node
"""
