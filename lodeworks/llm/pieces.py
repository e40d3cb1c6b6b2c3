"""SentencePiece encoding and decoding by streaming Viterbi.

The text runs through a trellis of pieces. Only a window as long as the longest
piece is kept: from a position further back no piece can still reach a later
one. Whenever all backpointer paths that survive in the window go through one
boundary, the ids before it are final and leave the encoder.

Two kinds of model share the trellis. A unigram model adds up piece scores. For
a BPE model, a step is admissible only if its two neighbouring pieces stay
apart when they are merged by rank, and then exactly one path survives to each
position: the one that merging by rank gives.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.common import make_room
from lodeworks.llm.textbytes import Roller, frugal, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
MISS, START, OUT_OF_VOCABULARY = -9, -3, -2
_ROLL = Roller(seed=41)
CACHE = 320_000


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) fields of a serialized protocol-buffer message."""
    i, n = 0, len(buf)

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = buf[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, buf[i : i + size]
            i += size


class Table:
    """A map from 64-bit keys to small numbers, for many keys at a time: open addressing over arrays."""

    def __init__(self, bits: int = 12) -> None:
        self.bits, self.count = bits, 0
        self.keys = np.zeros(1 << bits, dtype=np.uint64)  # 0 is empty; keys are never 0
        self.vals = np.full(1 << bits, MISS, dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), MISS, dtype=np.int32)
        at, slot = np.arange(len(keys)), self._slot(keys)
        while len(at):
            found = self.keys[slot]
            hit = found == keys[at]
            out[at[hit]] = self.vals[slot[hit]]
            on = ~hit & (found != 0)
            at, slot = at[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def put(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Add keys that differ from each other and from those that are there."""
        while 2 * (self.count + len(keys)) > 1 << self.bits:
            old = self.keys != 0
            k, v = self.keys[old], self.vals[old]
            Table.__init__(self, self.bits + 1)
            self.put(k, v)
        self.count += len(keys)
        slot = self._slot(keys)
        while len(keys):
            empty = self.keys[slot] == 0
            self.keys[slot[empty]] = keys[empty]
            placed = self.keys[slot] == keys
            self.vals[slot[placed]] = vals[placed]
            keys, vals, slot = keys[~placed], vals[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)


class Model:
    """A SentencePiece model file: pieces, scores, and what the encoder needs of its settings."""

    def __init__(self, blob: bytes) -> None:
        self.pieces: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        self.type, self.dummy_prefix, self.squeeze, self.byte_fallback = UNIGRAM, True, True, False
        charsmap = b""
        for number, value in _fields(blob):
            if number == 1:
                piece, score, kind = "", 0.0, 1
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif k == 3:
                        kind = v
                self.pieces.append(piece)
                self.score.append(score)
                self.kind.append(kind)
            elif number == 2:
                for k, v in _fields(value):
                    if k == 3:
                        self.type = v
                    elif k == 35:
                        self.byte_fallback = bool(v)
            elif number == 3:
                for k, v in _fields(value):
                    if k == 2:
                        charsmap = v
                    elif k == 3:
                        self.dummy_prefix = bool(v)
                    elif k == 4:
                        self.squeeze = bool(v)
        if charsmap:
            raise ValueError("only models with the identity normalizer are supported")
        if self.type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.index = {p: i for i, p in enumerate(self.pieces) if self.kind[i] in (1, 4)}
        self.unk = self.kind.index(2)
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if self.kind[i] == 6}
        self.longest = max(map(len, self.index), default=1)
        used = [self.score[i] for i in self.index.values()]
        self.unk_score = min(used, default=0.0) - 10.0
        self.inner_space = any(SPACE in p.lstrip(SPACE) for p in self.index)
        self.apart: dict[int, bool] = {}
        # marks that no piece joins with other characters: no path runs across their borders either
        pairs = {p[i : i + 2] for p in self.index for i in range(len(p) - 1)}
        marks = {c for p in self.index for c in p if not c.isalnum()} | {"\n"}
        marks.discard(SPACE)
        while odd := {c for x, y in pairs for c in (x, y) if c in marks and ((x in marks) != (y in marks)) and x != SPACE}:
            marks -= odd
        own = re.escape("".join(sorted(marks)))
        self.segments = re.compile(f"{SPACE}*[^{SPACE}{own}]+|{SPACE}*[{own}]+|{SPACE}+" if own else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.known = Table()
        self._tables: Table | None = None
        self.trie = {p[:i]: -1 for p in self.index for i in range(1, len(p))}
        self.trie.update(self.index)

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls(f.read())

    def merged(self, text: str) -> list[str]:
        """Merge by rank: again and again the pair whose piece scores best, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.index.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.score[piece] > best):
                    best, at = self.score[piece], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def admits(self, left: str, right: str) -> bool:
        """Whether the two pieces stay as they are when they stand side by side."""
        pair = self.index[left] << 32 | self.index[right]
        known = self.apart.get(pair)
        if known is None:
            if len(self.apart) >= 4 * CACHE:
                self.apart.clear()
            known = self.apart[pair] = self._apart(left, right)
        return known

    def _apart(self, left: str, right: str) -> bool:
        return left + right not in self.index and self.merged(left + right) == [left, right]

    def normalized(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        text = text.replace(" ", SPACE)
        return SPACE + text if self.dummy_prefix and text else text

    def stream(self, chars: Iterable[str]) -> Iterator[str]:
        """The pieces of a stream of characters, each as soon as it is final.

        Characters without a piece come out alone. State: one cell (score,
        piece, start) for each of the last `longest` + 1 positions, and the
        cells between the last committed boundary and the window.
        """
        index, longest, score = self.index, self.longest, self.score
        unigram = self.type == UNIGRAM
        buf = ""  # characters since the committed boundary
        cell: list[tuple[float, str, int] | None] = [(0.0, "", 0)]  # by end position, relative to it
        for ch in chars:
            buf += ch
            end = len(buf)
            best: tuple[float, str, int] | None = None
            for start in range(max(0, end - longest), end):
                before = cell[start]
                piece = buf[start:end]
                if before is None:
                    continue
                at = index.get(piece)
                if at is None:
                    if end - start > 1:
                        continue
                    gain = self.unk_score
                else:
                    gain = score[at]
                if unigram:
                    if best is None or before[0] + gain > best[0]:
                        best = (before[0] + gain, piece, start)
                elif self._follows(before[1], piece):
                    best = (0.0, piece, start)
                    break
            cell.append(best)
            if end >= 2 * longest + 2:
                cut = self._converged(cell, end)
                if cut:
                    yield from self._path(cell, cut)
                    base = cell[cut]
                    buf = buf[cut:]
                    cell = [(0.0, base[1], 0)] + [c and (c[0] - base[0], c[1], c[2] - cut) for c in cell[cut + 1 :]]
        yield from self._path(cell, len(buf))

    def _follows(self, left: str, right: str) -> bool:
        if not left or left not in self.index or right not in self.index:
            return True
        return self.admits(left, right)

    def _converged(self, cell: list, end: int) -> int:
        """The last boundary that the backpointer paths of all live positions share (0: none)."""
        live = {p for p in range(max(0, end - self.longest + 1), end + 1) if cell[p] is not None}
        while len(live) > 1:
            p = max(live)
            live.discard(p)
            live.add(cell[p][2])
        return live.pop()

    @staticmethod
    def _path(cell: list, end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(cell[end][1])
            end = cell[end][2]
        return out[::-1]

    def window(self, text: str) -> list[str]:
        """What stream() gives for a text that the window holds whole: one forward
        pass that walks the trie of pieces from each reachable position."""
        n = len(text)
        trie, score, unigram = self.trie, self.score, self.type == UNIGRAM
        total: list[float | None] = [0.0] + [None] * n
        cell: list[tuple[float, str, int] | None] = [(0.0, "", 0)] + [None] * n
        apart = self.apart
        ids = [-1] * (n + 1)
        for start in range(n):
            before, left = total[start], ids[start]
            if before is None:
                continue
            for end in range(start + 1, n + 1):
                piece = text[start:end]
                at = trie.get(piece)
                if at is None:
                    break
                if at < 0:
                    continue
                if unigram:
                    gain = before + score[at]
                    if total[end] is None or gain > total[end]:
                        total[end], cell[end] = gain, (gain, piece, start)
                elif total[end] is None:
                    if left >= 0:
                        ok = apart.get(left << 32 | at)
                        if not (self.admits(cell[start][1], piece) if ok is None else ok):
                            continue
                    total[end], cell[end], ids[end] = 0.0, (0.0, piece, start), at
            one = start + 1
            if text[start] not in self.index:
                gain = before + self.unk_score
                if total[one] is None or unigram and gain > total[one]:
                    total[one], cell[one], ids[one] = gain if unigram else 0.0, (gain, text[start], start), -1
        return self._path(cell, n)

    def windows(self, texts: list[str]) -> list[bytes]:
        """The ids (packed, 32 bits each) of many short texts: window(), for all of them at a time."""
        if self.type != BPE or not texts:
            return [self.packed(self.window(t)) for t in texts]
        if self._tables is None:
            names = list(self.trie)
            flat = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            end = np.cumsum([len(x) for x in names])
            self._tables = Table()
            self._tables.put(_ROLL.spans(flat, end - [len(x) for x in names], end, premul=mix(flat.astype(np.uint64) + np.uint64(7))) | np.uint64(1), np.array([self.trie[x] for x in names], dtype=np.int32))
        size = np.array([len(t) for t in texts])
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        key = mix(code.astype(np.uint64) + np.uint64(7))
        owner = np.repeat(np.arange(len(texts)), size)
        stop = np.cumsum(size)
        first = stop - size
        # all pieces from all places, one character longer at a time
        place = np.arange(len(code))
        starts, ends, ids = [], [], []
        for length in range(1, self.longest + 1):
            got = self._tables.get(_ROLL.spans(code, place, place + length, premul=key) | np.uint64(1))
            piece = got >= 0
            if length == 1:
                starts.append(place[~piece])
                ends.append(place[~piece] + 1)
                ids.append(OUT_OF_VOCABULARY - code[place[~piece]].astype(np.int64))
            starts.append(place[piece])
            ends.append(place[piece] + length)
            ids.append(got[piece].astype(np.int64))
            place = place[(got != MISS) & (place + length < stop[owner[place]])]
            if not len(place):
                break
        start, end, at = np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)
        text = owner[start]
        rel = end - first[text]
        by = np.argsort(rel, kind="stable")
        start, end, at, text, rel = start[by] + text[by], end[by] + text[by], at[by], text[by], rel[by]
        # a boundary for each character and one behind each text
        last = np.full(len(code) + len(texts), START, dtype=np.int64)
        back = np.zeros(len(last), dtype=np.int64)
        cut = np.searchsorted(rel, np.arange(1, int(size.max()) + 2))
        for a, b in zip(cut[:-1], cut[1:]):
            left, right = last[start[a:b]], at[a:b]
            ok = (left < 0) | (right < 0)
            ask = np.flatnonzero(~ok)
            if len(ask):
                pair = (left[ask] << 32 | right[ask]).astype(np.uint64) + np.uint64(1)
                said = self.known.get(pair)
                new = said == MISS
                if new.any():
                    fresh = np.unique(pair[new])
                    if self.known.count > 1_000_000:
                        self.known = Table()
                    answer = [self._apart(self.pieces[x >> 32], self.pieces[x & 0xFFFFFFFF]) for x in (fresh - np.uint64(1)).tolist()]
                    unseen = self.known.get(fresh) == MISS
                    self.known.put(fresh[unseen], np.array(answer, dtype=np.int32)[unseen])
                    said = self.known.get(pair)
                ok[ask] = said == 1
            last[end[a:b][ok]] = right[ok]
            back[end[a:b][ok]] = start[a:b][ok]
        # walk back from all ends at a time
        now, live = stop + np.arange(len(texts)), np.arange(len(texts))
        begin = first + np.arange(len(texts))
        steps, rows = [], []
        while len(live):
            steps.append(last[now])
            rows.append(live)
            now = back[now]
            on = now > begin[live]
            now, live = now[on], live[on]
        row, piece = np.concatenate(rows), np.concatenate(steps)
        by = np.argsort(row[::-1], kind="stable")
        row, piece = row[::-1][by], piece[::-1][by]
        raw = piece.astype(np.int32).tobytes()
        to = (4 * np.searchsorted(row, np.arange(len(texts) + 1))).tolist()
        out = [raw[x:y] for x, y in zip(to, to[1:])]
        for i in set(row[piece < 0].tolist()):
            path = piece[to[i] // 4 : to[i + 1] // 4].tolist()
            out[i] = self.packed(self.pieces[x] if x >= 0 else chr(OUT_OF_VOCABULARY - x) for x in path)
        return out

    def packed(self, path: Iterable[str]) -> bytes:
        return array("i", self.ids_of(path)).tobytes()

    def ids_of(self, pieces: Iterable[str]) -> tuple[int, ...]:
        out: list[int] = []
        for p in pieces:
            at = self.index.get(p)
            if at is not None:
                out.append(at)
            elif self.byte_fallback:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return tuple(out)

    def learn(self, segments: Iterable[str], cache: dict, older: dict) -> None:
        """See that cache holds all short segments; beyond its size, those not met lately move to older, then go."""
        if len(cache) >= CACHE:
            older.clear()
            older.update(cache)
            cache.clear()
        todo = []
        for seg in segments:
            if len(seg) <= 4 * self.longest:
                ids = older.get(seg)
                if ids is None:
                    todo.append(seg)
                else:
                    cache[seg] = ids
        cache.update(zip(todo, self.windows(todo)))

    def encode_segments(self, segments: list[str], cache: dict) -> bytes:
        try:
            return b"".join(map(cache.__getitem__, segments))
        except KeyError:
            return b"".join([ids if (ids := cache.get(s)) is not None else self.packed(self.stream(s) if len(s) > 4 * self.longest else self.window(s)) for s in segments])

    def encode(self, text: str) -> list[int]:
        """The ids of a text. No piece has a space mark after another character,
        so all paths converge before each run of space marks, and around runs of
        punctuation that no piece joins with letters: segments between such
        boundaries are independent."""
        norm = self.normalized(text)
        if self.inner_space:
            return list(self.ids_of(self.stream(norm)))
        return np.frombuffer(self.joined(self.encode_segments(self.segments(norm), {})), np.int32).tolist()

    def joined(self, raw: bytes) -> bytes:
        """Without byte pieces, unknown characters in a row are one unknown id."""
        if self.byte_fallback or not raw:
            return raw
        ids = np.frombuffer(raw, np.int32)
        twice = (ids == self.unk) & np.append(False, ids[:-1] == self.unk)
        return ids[~twice].tobytes()

    def decoder(self) -> list[bytes]:
        """The bytes of each id; control pieces are empty."""
        out = []
        for p, kind in zip(self.pieces, self.kind):
            out.append(bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else p.replace(SPACE, " ").encode())
        return out

    def decode(self, ids: Iterable[int], table: list[bytes] | None = None) -> str:
        table = table or self.decoder()
        raw = b"".join(map(table.__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def _shelf() -> dict:
    """What a Python worker keeps from task to task: models and their caches, by path."""
    return sys.__dict__.setdefault("_lodeworks_pieces", {})


def loaded(path: str) -> tuple[Model, dict, dict]:
    shelf = _shelf()
    if path not in shelf:
        shelf[path] = (Model.load(path), {}, {})
    return shelf[path]


def tokenize(docs: DataFrame, model_path: str = MODEL, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep with `ids`, `n_ids` and `exact`.

    model_path names the model file on every worker. ids: the encoding of the
    whole text. exact: whether decoding ids gives the text back. That holds for
    every text, but one with the space mark U+2581 itself, which decodes to a
    space, or with white space that the model's settings drop.
    Nulls: a null text has null ids and null n_ids, exact true; an empty text
    has no ids. Repeated rows are encoded each; other columns may be null. A
    column of keep that clashes with an output gets `_in` behind its name.
    """
    names = list(keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    rows = make_room(rows, ["ids", "n_ids", "exact", "_text"])
    names = rows.columns
    rows = make_room(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").cast("string").alias("_text")), [])

    def work(batches):
        model, *caches = loaded(model_path)
        table = model.decoder()

        def encoded(texts):
            """In runs of about a million characters: what no cache holds yet is encoded together."""
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and chars < 1_000_000:
                    chars += len(texts[to] or "")
                    to += 1
                if model.inner_space:
                    yield from (t if t is None else array("i", model.encode(t)).tobytes() for t in texts[at:to])
                else:
                    split = [None if t is None else model.segments(model.normalized(t)) for t in texts[at:to]]
                    new = set()
                    for segs in split:
                        new.update(segs or ())
                    if len(caches[0]) >= CACHE:
                        model.learn((), *caches)
                    model.learn(new.difference(caches[0]), *caches)
                    for segs in split:
                        yield None if segs is None else model.joined(model.encode_segments(segs, caches[0]))
                at = to

        for batch in batches:
            flat, size, exact = [], [], []
            texts = batch.column("_text").to_pylist()
            for t, raw in zip(texts, encoded(texts)):
                if t is None:
                    size.append(-1)
                    exact.append(True)
                    continue
                exact.append(model.decode(np.frombuffer(raw, np.int32).tolist(), table) == t)
                size.append(len(raw) // 4)
                flat.append(raw)
            n = np.array(size, dtype=np.int64)
            off = np.zeros(len(n) + 1, dtype=np.int32)
            np.cumsum(np.maximum(n, 0), out=off[1:])
            gone = n < 0
            values = pa.array(np.frombuffer(b"".join(flat), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(off), values, mask=pa.array(gone))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], ids, pa.array(np.maximum(n, 0).astype(np.int32), mask=gone), pa.array(exact)], [*names, "ids", "n_ids", "exact"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(frugal(work), f"{out}, ids array<int>, n_ids int, exact boolean")


def detokenize(rows: DataFrame, model_path: str = MODEL, ids: str = "ids", output: str = "text") -> DataFrame:
    """rows with the text that ids stand for; null ids give a null text, no ids an empty one."""
    rows = make_room(rows, [output])
    names = rows.columns
    at = names.index(ids)

    def work(batches):
        model, *_ = loaded(model_path)
        table = model.decoder()
        for batch in batches:
            texts = [None if v is None else model.decode(v, table) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, output])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(frugal(work), f"{out}, `{output}` string")
