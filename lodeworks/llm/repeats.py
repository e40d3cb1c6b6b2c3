"""Suffix-array dedup: passages that occur more than once in the corpus.

The order of all suffixes and their common prefixes come from a Burrows-Wheeler
transform: starting with the empty string, intervals of suffixes that share a
prefix are extended backwards, breadth first, by every word in front of them.
Prefix lengths are thus found by increasing value, and the search stops at the
minimum length: what is still open then is a repeat.

To split the corpus exactly, each text is cut down to the surroundings of its
anchors. A window of min_words words has the same least hash of ANCHOR_WORDS
consecutive words in every document, so all copies of a window meet in the
shard of that hash, with enough words around it to hold the whole window. Where
an anchor has more places than one task should hold, its windows themselves are
the keys: counted by an aggregate, which no hot key slows down.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.common import free, grown, landed, make_room
from lodeworks.llm.textbytes import Roller, chunks, frugal, mix, text_column, words

MIN_WORDS = 50
ANCHOR_WORDS = 16
SHARD_WORDS = 500_000
#: Anchors at more places than this are counted window by window.
HOT_PLACES = 20_000
NO_ID = -(1 << 63)
WORD_ROLL, GRAM_ROLL = Roller(seed=21), Roller(seed=22)


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i : i + w] for every i (shorter at the end), by doubling."""
    out, have = x.copy(), 1
    while have < w:
        step = min(have, w - have)
        out[: len(out) - step] = op(out[: len(out) - step], out[step:].copy())
        have += step
    return out


def anchors(hashes: np.ndarray, first: np.ndarray, min_words: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (starts of k words) to anchor at, and the hash at every place; first: each document's first word, and the end.

    Every run of min_words words inside a document holds an anchored place whose
    k-word hash is the least of the run.
    """
    n, w = len(hashes), min_words - k + 1
    grams = n - k + 1
    if n < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(grams)
    gram = GRAM_ROLL.spans(hashes, at, at + k, premul=hashes)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = doc[: n - min_words + 1] == doc[min_words - 1 :]
    least = sliding(gram, w, np.minimum)[: n - min_words + 1]
    # the greatest of the window minima that cover a place is the place's own hash: it is the least somewhere
    cover = np.zeros(grams, dtype=np.uint64)
    cover[: len(least)] = np.where(whole, least, np.uint64(0))
    cover = sliding(cover[::-1].copy(), w, np.maximum)[::-1]
    used = np.zeros(grams, dtype=bool)
    used[: len(whole)] = whole
    used = sliding(used[::-1].copy(), w, np.logical_or)[::-1]
    chosen = used & (cover == gram)
    # in a run of equal hashes its ends and every w-th place serve all windows
    same = np.zeros(grams + 1, dtype=bool)
    same[1:-1] = chosen[1:] & chosen[:-1] & (gram[1:] == gram[:-1])
    start = np.maximum.accumulate(np.where(~same[:-1], at, 0))
    return np.flatnonzero(chosen & (~same[:-1] | ~same[1:] | ((at - start) % w == 0))), gram


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of text and its inverse, by prefix doubling (text has unique end marks)."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    step = np.zeros(n, np.int64)
    key = text.astype(np.int64)
    size = 1
    while True:
        new = key[order]
        step[1:] = new[1:] != new[:-1]
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n - 1:
            return order, rank
        after = np.zeros(n, np.int64)
        after[:-size] = rank[size:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        size *= 2


def open_borders(text: np.ndarray, order: np.ndarray, rank: np.ndarray, least: int) -> np.ndarray:
    """For each border i between order[i - 1] and order[i]: whether they share a prefix of `least` symbols.

    Breadth-first: at level l the queue holds the intervals of strings of length
    l whose right border was closed at that level. The rows of an interval,
    grouped by the symbol before them (the transform), are the intervals of the
    strings one symbol longer; a border that such an interval ends at and that
    is still open has the common prefix l.
    """
    n = len(text)
    before = np.where(order == 0, n - 1, order - 1)
    back = rank[before]  # where each row's suffix lies with the symbol before it in front
    symbol = text[before]
    opened = np.ones(n + 1, dtype=bool)
    opened[[0, n]] = False
    lo, hi = np.array([0]), np.array([n])
    for _ in range(least):
        size = hi - lo
        total = int(size.sum())
        if not total:
            break
        owner = np.repeat(np.arange(len(lo)), size)
        row = np.arange(total) + np.repeat(lo - (np.cumsum(size) - size), size)
        to = back[row]
        by = np.argsort(to, kind="stable")
        to, owner, sym = to[by], owner[by], symbol[row[by]]
        cut = np.ones(total, dtype=bool)
        cut[1:] = (owner[1:] != owner[:-1]) | (sym[1:] != sym[:-1])
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], total) - 1
        lo, hi = to[starts], to[ends] + 1
        new = opened[hi]
        lo, hi = lo[new], hi[new]
        opened[hi] = False
    return opened[:n]


def repeated(pieces: list[np.ndarray], doc: np.ndarray, start: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that occur at two or more places: document, first word, and whether no other place comes before.

    pieces: word hashes; doc: rank of each piece's document; start: place of its first word in it.
    """
    none = np.zeros(0, np.int64)
    size = np.array([len(p) for p in pieces], dtype=np.int64)
    if not size.sum():
        return none, none, none.astype(bool)
    m = len(pieces)
    flat = np.concatenate(pieces)
    _, dense = np.unique(flat, return_inverse=True)
    at = np.arange(len(flat)) + np.repeat(np.arange(m), size)
    text = np.empty(len(flat) + m, dtype=np.int64)
    owner = np.repeat(np.arange(m), size + 1)
    text[at] = dense + m
    ends = np.cumsum(size + 1) - 1
    text[ends] = np.arange(m)
    order, rank = suffix_order(text)
    group = np.cumsum(~open_borders(text, order, rank, min_words))
    offset = np.arange(len(text)) - (ends - size)[owner]
    place = start[owner] + offset
    d, p = doc[owner][order], place[order]
    twice = np.bincount(group, minlength=group[-1] + 1)[group] > 1
    group, d, p = group[twice], d[twice], p[twice]
    if not len(group):
        return none, none, none.astype(bool)
    by = np.lexsort((p, d, group))
    group, d, p = group[by], d[by], p[by]
    fresh = np.ones(len(group), dtype=bool)
    fresh[1:] = (group[1:] != group[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1])
    group, d, p = group[fresh], d[fresh], p[fresh]
    head = np.ones(len(group), dtype=bool)
    head[1:] = group[1:] != group[:-1]
    alone = head & np.append(head[1:], True)
    return d[~alone], p[~alone], head[~alone]


def runs_of(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct consecutive places as runs: document, from, to (exclusive)."""
    if not len(doc):
        return doc, place, place
    by = np.lexsort((place, doc))
    doc, place = doc[by], place[by]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)
    i = np.flatnonzero(new)
    return doc[i], place[i], place[np.append(i[1:], len(doc)) - 1] + 1


def _joined(runs: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _without(runs: list[list[int]], holes: list[list[int]]) -> list[list[int]]:
    out = []
    for a, b in runs:
        for x, y in holes:
            if y <= a or x >= b:
                continue
            if x > a:
                out.append([a, x])
            a = max(a, y)
        if a < b:
            out.append([a, b])
    return out


def _identity(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.col(f"`{text}`").cast("string")
    return docs.select(F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(NO_ID)).alias("k"), F.xxhash64(t).alias("th"), t.alias("text"))


def spans(docs: DataFrame, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS, key: str = "doc_id", text: str = "text", hot_places: int = HOT_PLACES) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), first: the repeated passages.

    Words are runs without ASCII white space, compared byte for byte; characters
    from U+3000 to U+9FFF are words of their own. A window
    of min_words words is repeated if it occurs at another place, in any
    document or in the same one. first says that of its places this one comes
    first, by (doc_id, hash of the text, place); overlapping windows of one
    kind are one passage. Every window of every text counts, however long.
    A null key sorts first and counts as one document for each distinct text;
    null texts and those with fewer than min_words words have no repeats. Rows
    with one key and one text count as one document. An empty table gives no
    rows. Other columns are ignored, whatever their names. hot_places: from how
    many places on an anchor's windows are counted one by one; it changes no result.
    """
    found = _core(docs, min_words, anchor_words, key, text, hot_places)
    return found.select(F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"), "start_word", "end_word", "first")


def _hot_windows(doc_side: DataFrame, hot: DataFrame, min_words: int, side: int) -> DataFrame:
    """k, th, lo, hi, head: the repeated windows around hot anchors (k, th, p), each
    window a run of its own. Windows are compared by two 64-bit hashes of their words."""
    wanted = hot.groupBy(F.col("k").alias("k2"), F.col("th").alias("th2")).agg(F.collect_list("p").alias("ps"))
    near = doc_side.join(grown(wanted), (F.col("k") == F.col("k2")) & (F.col("th") == F.col("th2"))).select("k", "th", "ps", "text").dropDuplicates(["k", "th"])

    def windows(batches):
        for batch in batches:
            raw, off = text_column(batch, "text")
            k, th, ps = batch.column("k").to_numpy(), batch.column("th").to_numpy(), batch.column("ps")
            po, pv = ps.offsets.to_numpy(), ps.values.to_numpy()
            for a, b in chunks(off):
                data, offs = raw[off[a] : off[b]], off[a : b + 1] - off[a]
                s, e = words(data, offs)
                first = np.searchsorted(s, offs)
                code = WORD_ROLL.spans(data, s, e)
                doc = np.repeat(np.arange(b - a), np.diff(po[a : b + 1]))
                p = pv[po[a] : po[b]].astype(np.int64)
                lo = np.maximum(p - side, 0)
                size = np.maximum(np.minimum(p, np.diff(first)[doc] - min_words) - lo + 1, 0)
                at = np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)
                key = np.unique(np.repeat(doc, size) << 40 | at)
                doc, at = key >> 40, key & ((1 << 40) - 1)
                begin = first[doc] + at
                one = GRAM_ROLL.spans(code, begin, begin + min_words, premul=code)
                two = WORD_ROLL.spans(code, begin, begin + min_words, premul=mix(code))
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(k[a:b][doc]), pa.array(th[a:b][doc]), pa.array(at.astype(np.int32))], ["h1", "h2", "k", "th", "lo"])

    each = landed(near.mapInArrow(frugal(windows), "h1 bigint, h2 bigint, k bigint, th bigint, lo int"), "windows")
    place = F.struct("k", "th", "lo")
    heads = each.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").drop("b")
    return each.join(heads, ["h1", "h2"]).select("k", "th", "lo", (F.col("lo") + 1).alias("hi"), (place == F.col("a")).alias("head"))


def _core(docs: DataFrame, min_words: int, anchor_words: int, key: str, text: str, hot_places: int = HOT_PLACES) -> DataFrame:
    side = min_words - anchor_words
    doc_side = _identity(docs, key, text)

    def anchor(batches):
        for batch in batches:
            raw, off = text_column(batch, "text")
            k, th = batch.column("k").to_numpy(), batch.column("th").to_numpy()
            out = []
            for a, b in chunks(off):
                data, offs = raw[off[a] : off[b]], off[a : b + 1] - off[a]
                s, e = words(data, offs)
                first = np.searchsorted(s, offs)
                n = np.diff(first)
                if not (n >= min_words).any():
                    continue
                at, gram = anchors(WORD_ROLL.spans(data, s, e), first, min_words, anchor_words)
                cut = np.searchsorted(at, first)
                local = (at - first[np.searchsorted(first, at, side="right") - 1]).astype(np.int32)
                h = gram[at].astype(np.int64) if len(at) else np.zeros(0, np.int64)
                use = np.flatnonzero(n >= min_words)
                lo = np.zeros(len(use) + 1, np.int32)
                lo[1:] = np.cumsum(cut[use + 1] - cut[use])
                out.append(pa.RecordBatch.from_arrays([pa.array(k[a:b][use]), pa.array(th[a:b][use]), pa.array(n[use].astype(np.int32)), pa.ListArray.from_arrays(pa.array(lo), pa.array(h)), pa.ListArray.from_arrays(pa.array(lo), pa.array(local))], ["k", "th", "n", "hs", "ps"]))
            yield from out

    schema = "k bigint, th bigint, n int, hs array<bigint>, ps array<int>"
    anchored = landed(doc_side.where("text is not null").mapInArrow(frugal(anchor), schema), "anchors")

    # whole copies: every window of theirs occurs in the copy with the least key
    copies = anchored.groupBy("th").agg(F.min("k").alias("head"), F.max("k").alias("last")).where("last > head").select(F.col("th").alias("th2"), "head")
    marked = landed(anchored.select("k", "th", "n").join(copies, F.col("th") == F.col("th2")).drop("th2"), "copies")
    whole = marked.select("k", "th", F.lit(0).alias("lo"), (F.col("n") - (min_words - 1)).alias("hi"), (F.col("k") == F.col("head")).alias("head"))
    extra = marked.where("k > head").select(F.col("k").alias("k2"), F.col("th").alias("th2")).distinct()
    distinct = anchored.join(grown(extra), (F.col("k") == F.col("k2")) & (F.col("th") == F.col("th2")), "left_anti")

    flat = distinct.select("k", "th", F.explode(F.arrays_zip("hs", "ps")).alias("a")).select(F.col("a.hs").alias("h"), "k", "th", F.col("a.ps").alias("p"))
    often = flat.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = landed(flat.join(grown(often), "h"), "met")
    places, crowded = met.agg(F.count_if(F.col("c") <= hot_places), F.count_if(F.col("c") > hot_places)).first()
    hot = met.where(F.col("c") > hot_places).drop("c")
    met = met.where(F.col("c") <= hot_places).drop("c")
    shards = max(1, -(-places * (2 * side + anchor_words) // SHARD_WORDS))
    wanted = met.groupBy(F.col("k").alias("k2"), F.col("th").alias("th2")).agg(F.collect_list(F.struct("h", "p")).alias("a"))
    near = doc_side.join(grown(wanted), (F.col("k") == F.col("k2")) & (F.col("th") == F.col("th2"))).select("k", "th", F.col("a.h").alias("hs"), F.col("a.p").alias("ps"), "text")

    def surroundings(batches):
        for batch in batches:
            raw, off = text_column(batch, "text")
            k, th = batch.column("k").to_numpy(), batch.column("th").to_numpy()
            hs, ps = batch.column("hs"), batch.column("ps")
            ho, hv, pv = hs.offsets.to_numpy(), hs.values.to_numpy(), ps.values.to_numpy()
            for a, b in chunks(off):
                data, offs = raw[off[a] : off[b]], off[a : b + 1] - off[a]
                s, e = words(data, offs)
                first = np.searchsorted(s, offs)
                code = (WORD_ROLL.spans(data, s, e) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                doc = np.repeat(np.arange(b - a), np.diff(ho[a : b + 1]))
                p, h = pv[ho[a] : ho[b]].astype(np.int64), hv[ho[a] : ho[b]]
                n = np.diff(first)[doc]
                lo, hi = np.maximum(p - side, 0), np.minimum(p + anchor_words + side, n)
                size = hi - lo
                off32 = np.zeros(len(p) + 1, np.int32)
                off32[1:] = np.cumsum(size)
                idx = np.arange(int(off32[-1])) + np.repeat(first[doc] + lo - off32[:-1], size)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(k[a:b][doc]), pa.array(th[a:b][doc]), pa.array(lo.astype(np.int32)), pa.ListArray.from_arrays(pa.array(off32), pa.array(code[idx]))], ["h", "k", "th", "lo", "w"])

    around = near.mapInArrow(frugal(surroundings), "h bigint, k bigint, th bigint, lo int, w array<int>").repartition(shards, "h")

    def search(batches):
        h, k, th, lo, pieces = [], [], [], [], []
        for batch in batches:
            w = batch.column("w")
            o, v = w.offsets.to_numpy(), w.values.to_numpy()
            h.append(batch.column("h").to_numpy())
            k.append(batch.column("k").to_numpy())
            th.append(batch.column("th").to_numpy())
            lo.append(batch.column("lo").to_numpy().astype(np.int64))
            pieces += [v[o[i] : o[i + 1]] for i in range(batch.num_rows)]
        if not pieces:
            return
        ids = np.rec.fromarrays([np.concatenate(k), np.concatenate(th)])
        docs_, doc = np.unique(ids, return_inverse=True)
        lo_, h_ = np.concatenate(lo), np.concatenate(h)
        # anchors never share a window across hashes, so a shard may go in slices of whole hashes
        by = np.argsort(h_, kind="stable")
        size = np.cumsum(np.array([len(pieces[i]) for i in by]))
        at = 0
        while at < len(by):
            to = int(np.searchsorted(size, (size[at - 1] if at else 0) + SHARD_WORDS, side="right"))
            to = max(to, at + 1)
            while to < len(by) and h_[by[to]] == h_[by[to - 1]]:
                to += 1
            part = by[at:to]
            at = to
            d, p, head = repeated([pieces[i] for i in part], doc[part], lo_[part], min_words)
            for flag in (True, False):
                rd, a, b = runs_of(d[head == flag], p[head == flag])
                if len(rd):
                    yield pa.RecordBatch.from_arrays([pa.array(docs_.f0[rd]), pa.array(docs_.f1[rd]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(np.full(len(rd), flag))], ["k", "th", "lo", "hi", "head"])

    runs_schema = "k bigint, th bigint, lo int, hi int, head boolean"
    found = around.mapInArrow(frugal(search), runs_schema).unionByName(whole)
    if crowded:
        found = found.unionByName(_hot_windows(doc_side, hot, min_words, side))
    per_doc = found.groupBy("k", "th").agg(F.collect_list(F.struct("lo", "hi", "head")).alias("r"))

    def settle(batches):
        for batch in batches:
            ks, ts, a, b, f = [], [], [], [], []
            for k, th, rs in zip(batch.column("k").to_pylist(), batch.column("th").to_pylist(), batch.column("r").to_pylist()):
                later = _joined([(r["lo"], r["hi"]) for r in rs if not r["head"]])
                first = _without(_joined([(r["lo"], r["hi"]) for r in rs if r["head"]]), later)
                for flag, kind in ((True, first), (False, later)):
                    # window starts in [x, y) cover the words [x, y - 1 + min_words)
                    for x, y in _joined([(x, y - 1 + min_words) for x, y in kind]):
                        ks.append(k), ts.append(th), a.append(x), b.append(y), f.append(flag)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(ts, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(f, pa.bool_())], ["k", "th", "start_word", "end_word", "first"])

    return per_doc.mapInArrow(frugal(settle), "k bigint, th bigint, start_word int, end_word int, first boolean")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs without the words of later copies (spans with first = false).

    What stays of a text is the stretches between, joined by a line feed where
    words were taken out; texts without a later copy are untouched. length, if
    docs has such a column, is set to the new number of characters of the texts
    that change. A document that loses all its words goes. Nulls, ties, repeated
    rows and very long texts are as in spans(); all columns of docs are kept,
    whatever their names; an empty table stays empty.
    """
    cut = _core(docs, min_words, anchor_words, key, text).where("not first").groupBy(F.col("k").alias("_k2"), F.col("th").alias("_th2")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("_cuts"))
    names = docs.columns
    base = make_room(docs, ["_k", "_th", "_k2", "_th2", "_cuts"])
    same = dict(zip(names, base.columns))
    t = F.col(f"`{same[text]}`").cast("string")
    base = base.withColumn("_k", F.coalesce(F.col(f"`{same[key]}`").cast("bigint"), F.lit(NO_ID))).withColumn("_th", F.xxhash64(t))
    cut = landed(cut, "cuts")
    both = base.join(grown(cut), (F.col("_k") == F.col("_k2")) & (F.col("_th") == F.col("_th2")), "left")
    calm = both.where("_cuts is null").select(*[F.col(f"`{same[c]}`").alias(c) for c in names])
    hit = both.where("_cuts is not null").select(*[F.col(f"`{same[c]}`").alias(c) for c in names], F.col("_cuts").alias(free(names, "_cuts")))
    counts = length in names if length else False

    def shorten(batches):
        for batch in batches:
            texts, cuts = batch.column(names.index(text)).to_pylist(), batch.column(len(names)).to_pylist()
            new = []
            for t, cs in zip(texts, cuts):
                raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
                s, e = words(raw, np.array([0, len(raw)]))
                keep, at = [], 0
                for c in sorted(cs, key=lambda c: c["start_word"]):
                    x, y = c["start_word"], min(c["end_word"], len(s))
                    if x > at:
                        keep.append(raw[(s[at] if at else 0) : e[x - 1]].tobytes())
                    at = max(at, y)
                if at < len(s):
                    keep.append(raw[s[at] :].tobytes())
                new.append(b"\n".join(keep).decode("utf-8", "surrogatepass"))
            cols = list(batch.columns[: len(names)])
            cols[names.index(text)] = pa.array(new, cols[names.index(text)].type)
            if counts:
                cols[names.index(length)] = pa.array([len(x) for x in new]).cast(cols[names.index(length)].type)
            out = pa.RecordBatch.from_arrays(cols, names)
            yield out.filter(pa.array([bool(x) for x in new]))

    return calm.unionByName(hit.mapInArrow(frugal(shorten), T.StructType(docs.schema.fields)))


def spans_sql(min_words: int = MIN_WORDS) -> str:
    """The same from all windows, for documents whose ids differ."""
    more = min_words - 1
    return rf"""
with d as (select distinct doc_id, text from documents where text is not null),
w as (select doc_id, regexp_extract_all(text, '[\x{{3000}}-\x{{9FFF}}]|[^ \t\n\r\f\v\x{{3000}}-\x{{9FFF}}]+') as w from d),
x as (select doc_id, w, unnest(generate_series(1, len(w) - {more})) as i from w where len(w) > {more}),
h as (select doc_id, i - 1 as s, md5(array_to_string(w[i : i + {more}], ' ')) as h from x),
m as (select *, count(*) over (partition by h) as c, row_number() over (partition by h order by doc_id nulls first, s) = 1 as first from h),
k as (select doc_id, s, first, s > lag(s) over (partition by doc_id, first order by s) + {min_words} as cut from m where c > 1),
r as (select *, count(*) filter (where cut) over (partition by doc_id, first order by s) as run from k)
select doc_id, min(s)::int as start_word, (max(s) + {min_words})::int as end_word, first from r group by doc_id, first, run
"""
