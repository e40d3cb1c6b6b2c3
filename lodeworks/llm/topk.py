"""Exact top-k search by inner product.

Vectors are sorted by length, longest first, and cut into blocks. A first pass
lets every block search itself: that gives each query a floor, its k-th best so
far. A block is then sent to a group of queries only if its longest vector can
still reach one of their floors. There the products are summed over the first
axes of an SVD rotation; by Cauchy-Schwarz the rests add at most the product of
their lengths, which goes along as one more axis, so that one matrix product
gives the bounds of all pairs. How many axes the partial sums take is chosen for
each block, by the pairs that a sample leaves over; pairs whose bound reaches
the floor are computed exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import landed
from lodeworks.llm.textbytes import frugal

PRODUCTION = dict(k=10, block=2048, group_bytes=32 << 20)
SLACK = 2e-6
#: What one surviving pair costs, in multiplications of the matrix product.
GATHER = 3000


def vectors(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    lists = batch.column(name)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v: rows with a key and a vector of numbers without null, NaN or infinity, as float."""
    v = F.col(f"`{vector}`").cast("array<float>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.where(F.col(f"`{key}`").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))).select(F.col(f"`{key}`").cast("bigint").alias("id"), v.alias("v"))


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors of the whole table, from its sum of outer products (dim x dim numbers)."""

    def outer(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = vectors(batch, "v", dim).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["g"])

    total = np.zeros(dim * dim)
    for r in rows.select("v").mapInArrow(frugal(outer), "g array<double>").toLocalIterator():
        total += np.array(r[0])
    _, axes = np.linalg.eigh(total.reshape(dim, dim))
    return axes[:, ::-1].copy()


class Best:
    """The k best (rounded score, id) of each query so far; low: floors that are known beforehand."""

    def __init__(self, n: int, k: int, low: np.ndarray | None = None) -> None:
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.low = np.full(n, -np.inf) if low is None else low

    def floor(self) -> np.ndarray:
        """Below this no product can enter."""
        return np.maximum(self.score[:, -1] - SLACK, self.low)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        hit = np.unique(q)
        k = self.k
        qs = np.concatenate([np.repeat(hit, k), q])
        ss = np.concatenate([self.score[hit].ravel(), score])
        xs = np.concatenate([self.id[hit].ravel(), ids])
        by = np.lexsort((xs, -ss, qs))
        qs, ss, xs = qs[by], ss[by], xs[by]
        head = np.searchsorted(qs, hit)
        take = head[:, None] + np.arange(k)
        self.score[hit], self.id[hit] = ss[take], xs[take]


class Side:
    """Vectors by descending length, and what the bounds need of them."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, turn: np.ndarray) -> None:
        self.x, self.ids = x, ids
        wide = x.astype(np.float64)
        # products of such lengths must stay within the type
        kind = np.float32 if np.abs(x).max(initial=0.0) < 1e15 else np.float64
        self.turned = (wide @ turn).astype(kind)
        self.length = np.sqrt(np.einsum("ij,ij->i", wide, wide))
        # upper bounds of the lengths behind each cut: sums of squares from the last axis on
        self.rest = np.sqrt(np.cumsum(self.turned[:, ::-1].astype(np.float64) ** 2, axis=1)[:, ::-1])

    def bound_rows(self, cut: int) -> np.ndarray:
        """The first cut axes, and the length of the rest as one more."""
        if cut >= self.x.shape[1]:
            return self.turned
        return np.concatenate([self.turned[:, :cut], self.rest[:, cut : cut + 1].astype(self.turned.dtype)], axis=1)


def chosen_cut(q: Side, rows: np.ndarray, x: Side, floor: np.ndarray) -> int:
    """The number of axes (a quarter, half, three quarters, all) with the least expected work, from a sample of pairs."""
    dim = x.x.shape[1]
    best, cut = float(dim + GATHER * 2e-5), dim
    at = rows[:: max(1, len(rows) // 128)]
    some = np.arange(0, len(x.x), max(1, len(x.x) // 512))
    for c in sorted({max(1, dim * i // 4) for i in (1, 2, 3)} - {dim}):
        bound = q.bound_rows(c)[at] @ x.bound_rows(c)[some].T
        cost = c + 1 + GATHER * float((bound >= floor[at][:, None]).mean())
        if cost < best:
            best, cut = cost, c
    return cut


def meet(best: Best, q: Side, x: Side) -> tuple[int, int]:
    """Let a block of items compete for the queries; returns the pairs bounded and the pairs computed.

    float32 products of these lengths are off by less than the margin that the
    floors are lowered by; what survives is computed in float64.
    """
    dim = x.x.shape[1]
    margin = 4e-7 * (dim + 8) * float(x.length[:1].max(initial=0.0)) * q.length
    floor = best.floor() - margin
    # items shorter than this reach no query at all
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(floor <= 0, 0.0, floor / q.length)
    rows = np.flatnonzero(x.length[:1].max(initial=-1.0) >= need)
    if not len(rows):
        return 0, 0
    bounded = computed = 0
    known = rows[~np.isinf(floor[rows])]
    cut = chosen_cut(q, known, x, floor) if len(known) else dim
    left, right = q.bound_rows(cut), x.bound_rows(cut)
    step = max(1, 2_000_000 // max(1, len(x.x)))
    for lo in range(0, len(rows), step):
        at = rows[lo : lo + step]
        low = floor[at]
        upto = int(np.searchsorted(-x.length, -need[at].min(), side="right"))
        if not upto:
            continue
        if np.isinf(low).any():
            # no k-th best yet: that of these items, less the margin, and with the query's own rows out
            score = q.turned[at] @ x.turned[:upto].T
            score[q.ids[at, None] == x.ids[None, :upto]] = -np.inf
            k = min(best.k, upto)
            low = np.maximum(low, np.partition(score, upto - k, axis=1)[:, upto - k] - SLACK - 2 * margin[at])
        else:
            score = left[at] @ right[:upto].T
        bounded += score.size
        flat = np.flatnonzero((score >= low.astype(score.dtype)[:, None]).ravel())
        r, c = np.divmod(flat, upto)
        r = at[r]
        ok = q.ids[r] != x.ids[c]
        r, c = r[ok], c[ok]
        for a in range(0, len(r), 200_000):
            rr, cc = r[a : a + 200_000], c[a : a + 200_000]
            s = np.einsum("ij,ij->i", q.x[rr].astype(np.float64), x.x[cc].astype(np.float64))
            fine = s >= best.floor()[rr]
            best.add(rr[fine], np.round(s[fine], 6) + 0.0, x.ids[cc[fine]])
        computed += len(r)
    return bounded, computed


def top_k(table: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, block: int = 2048, group_bytes: int = 32 << 20) -> DataFrame:
    """vec_id, rank, neighbor_id, score: for every row its k best other rows by inner product.

    Exact: scores are rounded to 6 decimals, ties go to the smaller id. A vector
    is no neighbour of rows with its own key; rows with one key are all queries
    and all items. Fewer than k others give fewer rows; an empty table none.
    Nulls: rows without a key, without a vector, or with a null, NaN or infinite
    element are neither query nor item; only vectors of one length meet, however
    long. Zero vectors score 0. Other columns are ignored, whatever their names.
    block: vectors that travel together; group_bytes: the queries that a task
    holds, as float32, at most. A task's memory is its queries and one block;
    the shuffle is the table times the number of groups whose floors let it in.
    """
    rows = landed(usable(table, key, vector), "vectors")
    dims = [r[0] for r in rows.select(F.size("v")).distinct().collect()]
    parts = [_one_dim(rows.where(F.size("v") == d), d, k, block, group_bytes) for d in sorted(dims)]
    schema = "vec_id bigint, rank int, neighbor_id bigint, score double"
    if not parts:
        return table.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def packed_blocks(rows: DataFrame, dim: int, k: int, block: int, turn: np.ndarray) -> DataFrame:
    """no, top, need, ids, vs, low: blocks by descending length, numbered from the longest.

    need: the length below which no vector reaches any of the block's queries,
    from the block's search of itself; low: those queries' floors.
    """
    length = F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))

    def pack(batches):
        held: list[pa.RecordBatch] = []
        count = done = 0

        def block_of(t: pa.Table):
            nonlocal done
            v = vectors(t.combine_chunks().to_batches()[0], "v", dim).astype(np.float32)
            side = Side(v, t.column("id").to_numpy().astype(np.int64), turn)
            best = Best(len(v), k)
            meet(best, side, side)
            low = best.floor()
            with np.errstate(divide="ignore", invalid="ignore"):
                need = float(np.where(low <= 0, 0.0, low / side.length * (1 - 1e-6)).min())
            uid = (TaskContext.get().partitionId() << 32) + done
            done += 1
            cells = [pa.array([x.tobytes()], pa.binary()) for x in (side.ids, v, low)]
            return pa.RecordBatch.from_arrays([pa.array([uid]), pa.array([float(side.length.max())]), pa.array([need]), *cells], ["uid", "top", "need", "ids", "vs", "low"])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= block:
                t = pa.Table.from_batches(held)
                yield block_of(t.slice(0, block))
                rest = t.slice(block)
                held, count = rest.to_batches(), rest.num_rows
        if count:
            yield block_of(pa.Table.from_batches(held))

    sorted_rows = rows.withColumn("l", length).sort(F.desc("l"), "id").select("id", "v")
    packed = landed(sorted_rows.mapInArrow(frugal(pack), "uid bigint, top double, need double, ids binary, vs binary, low binary"), "blocks")
    # one line for each block: partitions follow each other by length, and so do their blocks
    order = [r[0] for r in packed.select("uid").sort("uid").toLocalIterator()]
    names = rows.sparkSession.createDataFrame([(u, i) for i, u in enumerate(order)], "uid bigint, no int")
    return packed.join(names, "uid").select("no", "top", "need", "ids", "vs", "low")


def sent_blocks(blocks: DataFrame, dim: int, block: int, group_bytes: int) -> tuple[DataFrame, int]:
    """at, kind, no, ids, vs, low: each group's queries (kind 0), then the items that may reach
    one of its floors (kind 1); and the number of groups: at least as many as cores, while there are blocks."""
    spark = blocks.sparkSession
    n = blocks.count()
    most = max(1, group_bytes // (4 * dim * block))
    each = max(1, min(most, -(-n // spark.sparkContext.defaultParallelism)))
    grouped = blocks.withColumn("own", F.expr(f"no div {each}").cast("int"))
    needs = grouped.groupBy(F.col("own").alias("at")).agg(F.min("need").alias("least"))
    # a line for each group: 16 bytes for group_bytes of vectors
    items = grouped.drop("need").join(F.broadcast(needs), F.col("top") >= F.col("least")).select("at", F.lit(1).alias("kind"), "no", "ids", "vs", F.lit(None).cast("binary").alias("low"))
    return grouped.select(F.col("own").alias("at"), F.lit(0).alias("kind"), "no", "ids", "vs", "low").unionByName(items), max(1, -(-n // each))


def _one_dim(rows: DataFrame, dim: int, k: int, block: int, group_bytes: int) -> DataFrame:
    turn = rotation(rows, dim)
    blocks = landed(packed_blocks(rows, dim, k, block, turn), "numbered")
    sent, groups = sent_blocks(blocks, dim, block, group_bytes)
    sent = sent.repartitionById(groups, F.col("at")).sortWithinPartitions("at", "kind", "no")

    def search(batches):
        mine, q, best = [], None, None
        for batch in batches:
            for kind, ids, vs, low in zip(batch.column("kind").to_pylist(), batch.column("ids"), batch.column("vs"), batch.column("low")):
                xid = np.frombuffer(ids.as_buffer(), dtype=np.int64)
                x = np.frombuffer(vs.as_buffer(), dtype=np.float32).reshape(-1, dim)
                if kind == 0:
                    mine.append((x, xid, np.frombuffer(low.as_buffer(), dtype=np.float64)))
                    continue
                if q is None:
                    x_, ids_, low_ = (np.concatenate(c) for c in zip(*mine))
                    q, best, mine = Side(x_, ids_, turn), Best(len(x_), k, low_), []
                meet(best, q, Side(x, xid, turn))
        if q is not None:
            r, c = np.nonzero(~np.isinf(best.score))
            for a in range(0, len(r), 1 << 20):
                rr, cc = r[a : a + (1 << 20)], c[a : a + (1 << 20)]
                yield pa.RecordBatch.from_arrays([pa.array(q.ids[rr]), pa.array((cc + 1).astype(np.int32)), pa.array(best.id[rr, cc]), pa.array(best.score[rr, cc])], ["vec_id", "rank", "neighbor_id", "score"])

    return sent.mapInArrow(frugal(search), "vec_id bigint, rank int, neighbor_id bigint, score double")


def topk_sql(k: int) -> str:
    return f"""
with e as (select vec_id, embedding::double[] as v from embeddings where vec_id is not null and embedding is not null),
s as (select a.vec_id, b.vec_id as neighbor_id, round(list_dot_product(a.v, b.v), 6) + 0.0 as score from e a join e b on a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by vec_id order by score desc, neighbor_id) as rank from s)
select vec_id, rank::int as rank, neighbor_id, score from r where rank <= {k}
"""
