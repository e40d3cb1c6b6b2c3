"""Toxicity by a factorization machine over hashed terms.

score = b + sum_i w_i + sum_{i<j} <v_i, v_j> over the distinct hashed terms of a
text: the factors learn pairs (an insult together with the mention of a group)
that an additive linear model has no weight for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import make_room
from lodeworks.llm.textbytes import Roller, chunks, frugal, give_back, terms, text_column

BUCKET_BITS = 20
PREFIX_BYTES = 5
TRAIN_ROWS = 20_000
ROLL = Roller(seed=11)
OUT = "score double, toxic boolean"


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms and the document of each: lower-cased words, and the first
    PREFIX_BYTES bytes of words longer than that, so inflected forms share one."""
    low, start, end = terms(data, offsets)
    doc = np.searchsorted(offsets, start, side="right") - 1
    whole = ROLL.spans(low, start, end)
    long = end - start > PREFIX_BYTES
    cut = ROLL.spans(low, start[long], start[long] + PREFIX_BYTES) ^ np.uint64(0x5851F42D4C957F2D)
    shift = np.uint64(64 - BUCKET_BITS)
    return np.concatenate([whole >> shift, cut >> shift]).astype(np.int64), np.concatenate([doc, doc[long]])


@dataclass
class Machine:
    """place[b] is the row of bucket b in w and v, or -1 where the term carries no weight."""

    place: np.ndarray
    w: np.ndarray
    v: np.ndarray
    bias: float
    cut: float

    def logits(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """doc, term: the distinct active terms of n documents."""
        lin = np.bincount(doc, weights=self.w[term], minlength=n)
        total = np.zeros((n, self.v.shape[1]))
        np.add.at(total, doc, self.v[term])
        square = np.bincount(doc, weights=(self.v[term] ** 2).sum(axis=1), minlength=n)
        return self.bias + lin + 0.5 * ((total**2).sum(axis=1) - square)

    def active(self, bucket: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.place[bucket]
        on = at >= 0
        pair = np.unique(doc[on].astype(np.int64) * len(self.w) + at[on]) if on.any() else np.zeros(0, np.int64)
        return pair // max(1, len(self.w)), pair % max(1, len(self.w))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities for the texts of a chunk."""
        n = len(offsets) - 1
        if not len(self.w):
            z = np.full(n, self.bias)
        else:
            z = self.logits(*self.active(*buckets(data, offsets)), n)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _tally(flat: np.ndarray, first: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """For each term the sum of the weights of its texts, some texts at a time."""
    out = np.zeros(size)
    for a in range(0, len(weight), 2048):
        b = min(len(weight), a + 2048)
        out += np.bincount(flat[first[a] : first[b]], weights=np.repeat(weight[a:b], np.diff(first[a : b + 1])), minlength=size)
    return out


def _only(flat: np.ndarray, first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' terms that have a number, as that number, and where each text's begin."""
    own = number[flat]
    on = own >= 0
    count = _sums(on, first).astype(np.int64)
    return own[on], np.concatenate([[0], np.cumsum(count)])


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x over the runs that begin at first (the last entry is the end); empty runs give 0."""
    out = np.zeros((len(first) - 1, *x.shape[1:]))
    some = np.diff(first) > 0
    if some.any():
        out[some] = np.add.reduceat(x, first[:-1][some], dtype=float)
    return out


def descend(m: Machine, flat: np.ndarray, first: np.ndarray, label: np.ndarray, epochs: int, rate: float, decay: float) -> None:
    """Full-batch Adam on the logistic loss with both classes weighted alike, in place."""
    doc = np.repeat(np.arange(len(label)), np.diff(first))
    by = np.argsort(flat, kind="stable")
    at = np.searchsorted(flat[by], np.arange(len(m.w) + 1))
    pos = label.sum()
    weight = np.where(label == 1, 0.5 / pos, 0.5 / (len(label) - pos))
    mom, var = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
    for step in range(1, epochs + 1):
        err, total = gradient(m, flat, first, label, weight)
        grads = [_sums(err[doc[by]], at) + decay * m.w, _sums(err[doc[by], None] * (total[doc[by]] - m.v[flat[by]]), at) + decay * m.v, err.sum()]
        new = []
        for k, (g, x) in enumerate(zip(grads, (m.w, m.v, m.bias))):
            mom[k] = 0.9 * mom[k] + 0.1 * g
            var[k] = 0.99 * var[k] + 0.01 * g * g
            new.append(x - rate * (mom[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-9))
        m.w, m.v, m.bias = new[0], new[1], float(new[2])


def gradient(m: Machine, flat: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The loss by each text's logit, and each text's sum of factors."""
    v = m.v[flat]
    total = _sums(v, first)
    z = m.bias + _sums(m.w[flat], first) + 0.5 * ((total**2).sum(axis=1) - _sums((v**2).sum(axis=1), first))
    return weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label), total


def partners(flat: np.ndarray, first: np.ndarray, label: np.ndarray, p: np.ndarray, least: float) -> np.ndarray:
    """Pairs (i, j, sign) of terms whose texts together are toxic far more or less often than p says.

    The measure is the log-likelihood ratio of the texts that have both terms,
    against the probabilities p of the machine so far. Exact: a term whose own
    texts can't add up to `least` is in no such pair, and is left out first.
    """
    n, terms = len(label), int(flat.max(initial=-1)) + 1
    p = np.clip(p, 1e-6, 1 - 1e-6)
    gain = -2 * np.log(np.where(label == 1, p, 1 - p))
    can = np.maximum(_tally(flat, first, gain * (label == 1), terms), _tally(flat, first, gain * (label == 0), terms)) >= least
    names = np.flatnonzero(can)
    k = len(names)
    found = [np.zeros((0, 3), np.int64)]
    flat, first = _only(flat, first, np.where(can, np.cumsum(can) - 1, -1).astype(np.int32))
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    for lo in range(0, k, 512):
        hi = min(k, lo + 512)
        sums = np.zeros((3, hi - lo, k - lo), np.float32)
        for a in range(0, n, 1024):
            b = min(n, a + 1024)
            x = np.zeros((b - a, k), np.float32)
            x[doc[first[a] : first[b]] - a, flat[first[a] : first[b]]] = 1
            left = x[:, lo:hi].T
            for out, scale in zip(sums, (None, label[a:b], p[a:b])):
                out += (left if scale is None else left * scale.astype(np.float32)) @ x[:, lo:]
        both, seen, want = sums.astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(seen > 0, seen * np.log(seen / want), 0) + np.where(both > seen, (both - seen) * np.log((both - seen) / (both - want)), 0))
        i, j = np.nonzero(np.triu(np.nan_to_num(ratio) >= least, 1))
        found.append(np.stack([names[i + lo], names[j + lo], np.sign(seen - want)[i, j].astype(np.int64)], axis=1))
    return np.concatenate(found)


def _joined(bucket: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of some texts end to end, and where each text's begin."""
    flat = np.concatenate([np.zeros(0, np.int32), *(bucket[i] for i in rows)])
    return flat, np.concatenate([[0], np.cumsum([len(bucket[i]) for i in rows], dtype=np.int64)])


def train(bucket: list[np.ndarray], label: np.ndarray, rank: int = 8, epochs: int = 300, min_chi2: float = 24.0, pair_ratio: float = 40.0, rate: float = 0.1, decay: float = 3e-4, seed: int = 5) -> Machine:
    """Fit on the distinct buckets of each labelled text.

    A term takes part if its own presence goes with the label (chi-square of
    min_chi2 at least), or if it is in a pair that does (log-likelihood ratio
    of pair_ratio at least, against what the terms so far explain), however
    neutral both look alone; what is left of some hundred thousand terms and
    some hundred million pairs is what chance alone would hardly give. cut is
    the threshold with the best F1 on the fifth of the rows that training
    leaves out.
    """
    n = len(label)
    place = np.full(1 << BUCKET_BITS, -1, dtype=np.int32)
    pos = int(label.sum())
    if n == 0 or pos == 0 or pos == n:
        return Machine(place, np.zeros(0), np.zeros((0, rank)), -40.0 if pos == 0 else 40.0, 0.5)
    rng = np.random.default_rng(seed)
    held = rng.random(n) < 0.2
    if label[~held].sum() in (0, (~held).sum()) or label[held].sum() == 0:
        held[:] = False
    fit = np.flatnonzero(~held)
    y = label[fit]
    flat, first = _joined(bucket, fit)
    np1, np0 = float(y.sum()), float((y == 0).sum())
    prior = float(np.log(np1 / np0)) - 1.0
    if not len(flat):
        return Machine(place, np.zeros(0), np.zeros((0, rank)), prior, 0.5)
    size = 1 << BUCKET_BITS
    a, seen = _tally(flat, first, y, size), _tally(flat, first, np.ones(len(y)), size)
    c = seen - a
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (np1 + np0) * (a * (np0 - c) - c * (np1 - a)) ** 2 / (np1 * np0 * seen * (np1 + np0 - seen))
    use = np.nan_to_num(chi) >= min_chi2

    def fitted(pairs: np.ndarray) -> tuple[Machine, np.ndarray]:
        number = np.where(use, np.cumsum(use) - 1, -1).astype(np.int32)
        k = int(use.sum())
        v = rng.normal(0, 0.05, (k, rank))
        # the factors of a pair start out pointing the way they will have to
        i, j = number[pairs[:, 0]], number[pairs[:, 1]]
        count = np.bincount(i, minlength=k) + np.bincount(j, minlength=k)
        push = rng.normal(0, 0.3, (len(pairs), rank)) / np.sqrt(rank * np.maximum(count[i], count[j]))[:, None]
        np.add.at(v, i, push)
        np.add.at(v, j, pairs[:, 2:] * push)
        m = Machine(number, np.zeros(k), v, prior, 0.5)
        own, starts = _only(flat, first, number)
        if k:
            descend(m, own, starts, y, epochs, rate, decay)
        err, _ = gradient(m, own, starts, y, np.ones(len(y)))
        return m, err + y

    m, p = fitted(np.zeros((0, 3), np.int64))
    odds = p / (1 - np.clip(p, 0, 1 - 1e-9)) * np1 / np0 if use.any() else np.full(len(y), np1 / np0)
    pairs = partners(flat, first, y, odds / (1 + odds), pair_ratio)
    if len(pairs):
        use[np.unique(pairs[:, :2])] = True
        m, _ = fitted(pairs)
    check = np.flatnonzero(held) if held.any() else fit
    own, starts = _only(*_joined(bucket, check), m.place)
    p = 1 / (1 + np.exp(-np.clip(m.logits(np.repeat(np.arange(len(check)), np.diff(starts)), own, len(check)), -40, 40)))
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(label[check][order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + max(1, label[check].sum()))
    best = int(f1.argmax())
    under = p[order[best + 1]] if best + 1 < len(order) else 0.0
    m.cut = float(np.clip((p[order[best]] + under) / 2, 0.2, 0.8))
    return m


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """Train on at most train_rows labelled texts, those with the smallest hash of their key.

    Rows with a null key, text or label are left out; a key that labels names
    twice counts with its greatest label, one that docs holds several times with
    one of its texts (that with the least hash of its terms). The sample's keys
    are broadcast: there are train_rows of them, whatever the size of the tables.
    """
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.max("y").alias("y"))
    bound = known.select(F.xxhash64("k").alias("h")).orderBy("h").limit(train_rows).agg(F.max("h")).first()[0]
    if bound is None:
        return train([], np.zeros(0))
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null").join(F.broadcast(known.where(F.xxhash64("k") <= bound)), "k").select("k", "y", "text")

    def features(batches):
        for batch in batches:
            raw, off = text_column(batch, "text")
            out = []
            for a, b in chunks(off):
                bucket, doc = buckets(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                pair = np.unique(doc << BUCKET_BITS | bucket)
                cut = np.searchsorted(pair, np.arange(b - a + 1, dtype=np.int64) << BUCKET_BITS)
                out += [(pair[x:y] & ((1 << BUCKET_BITS) - 1)).astype(np.int32) for x, y in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("k").cast(pa.string()), batch.column("y"), pa.array(out, pa.list_(pa.int32()))], ["k", "y", "f"])

    got = rows.mapInArrow(frugal(features), "k string, y int, f array<int>").groupBy("k").agg(F.max("y").alias("y"), F.min_by("f", F.xxhash64("f")).alias("f")).toArrow()
    order = np.argsort(np.array(got["k"].to_pylist(), dtype=str), kind="stable")
    lists = got["f"].combine_chunks()
    off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    machine = train([flat[off[i] : off[i + 1]] for i in order], got["y"].to_numpy()[order].astype(float))
    del got, lists, flat
    give_back()
    return machine


def rate(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """docs with `score` (probability of toxic) and `toxic` (score at or above the machine's cut).

    Nulls: a null text is scored as an empty one, from the bias alone, and is
    never toxic; other columns may be null and pass through. A text is scored
    whole, from the set of its terms: repeats within it don't count, its length
    doesn't dilute. Repeated rows get the same score each. Columns named score
    or toxic are kept as score_in, toxic_in.
    """
    docs = make_room(docs, ["score", "toxic"])
    names, schema = docs.columns, docs.schema

    def score(batches):
        for batch in batches:
            raw, off = text_column(batch.select([text]), text)
            p = np.zeros(batch.num_rows)
            for a, b in chunks(off):
                p[a:b] = machine.scores(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            some = np.diff(off) > 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= machine.cut) & some)], [*names, "score", "toxic"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.mapInArrow(frugal(score), f"{out}, {OUT}")
