"""Language ID by hyperdimensional profiles.

Every letter has a random +-1 vector. A trigram binds its letters, each permuted
(rotated) by its place, through the elementwise product. A text bundles
its trigram vectors by addition; so does a language over its sample. A text
belongs to the language whose prototype has the highest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.llm.common import landed, make_room
from lodeworks.llm.textbytes import CHUNK, chunks, frugal, lowered, text_column

DIM = 1024
SYMBOLS = 128
SAMPLE_DOCS = 1024
OUT = "lang_id string, cosine double, margin double"


def letter_vectors(dim: int = DIM, seed: int = 7) -> np.ndarray:
    return (np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dim)) * 2 - 1).astype(np.float32)


def trigram_vectors(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The bound vectors of trigram codes (a * SYMBOLS + b) * SYMBOLS + c."""
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return first[codes // SYMBOLS**2] * second[codes // SYMBOLS % SYMBOLS] * letters[codes % SYMBOLS]


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of the texts and the document of each: 0 for a gap between
    words (a run of anything but letters), 1-26 a-z, 27-58 the Latin-1 letters,
    59-127 other letters, by a hash of their bytes."""
    low = lowered(data).astype(np.int16)
    n = len(low)
    out = np.zeros(n, dtype=np.int16)
    ascii_letter = (low >= 97) & (low <= 122)
    out[ascii_letter] = low[ascii_letter] - 96
    lead = low >= 0xC2
    nxt = np.zeros(n, dtype=np.int16)
    nxt[:-1] = low[1:]
    after = np.zeros(n, dtype=np.int16)
    after[:-2] = low[2:]
    latin = lead & (low == 0xC3)
    out[latin] = 27 + ((nxt[latin] - 0xA0) & 31)
    other = lead & (low > 0xC3)
    out[other] = 59 + (low[other].astype(np.int64) * 131 + nxt[other].astype(np.int64) * 31 + np.where(low[other] >= 0xE0, after[other], 0)) % 69
    keep = (low < 0x80) | lead
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out, doc = out[keep], doc[keep]
    if len(out):
        run = np.ones(len(out), dtype=bool)
        run[1:] = (out[1:] != 0) | (out[:-1] != 0) | (doc[1:] != doc[:-1])
        out, doc = out[run], doc[run]
    return out, doc


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes of the chunk and a documents x codes matrix of counts."""
    n = len(offsets) - 1
    sym, doc = symbols(data, offsets)
    if len(sym) < 3:
        return np.zeros(0, np.int64), np.zeros((n, 0), np.float32)
    s = sym.astype(np.int64)
    code = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    ok = (doc[2:] == doc[:-2]) & (s[1:-1] != 0)
    code, at = code[ok], doc[:-2][ok]
    seen = np.zeros(SYMBOLS**3, dtype=bool)
    seen[code] = True
    codes = np.flatnonzero(seen)
    place = np.zeros(SYMBOLS**3, dtype=np.int32)
    place[codes] = np.arange(len(codes))
    counts = np.bincount(at * max(1, len(codes)) + place[code], minlength=n * len(codes))
    return codes, counts.reshape(n, len(codes)).astype(np.float32)


def bundle(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The documents' vectors; all zero where a text has no trigram."""
    codes, counts = trigram_counts(data, offsets)
    if not len(codes):
        return np.zeros((len(offsets) - 1, letters.shape[1]), np.float32)
    return counts @ trigram_vectors(codes, letters)


def _parts(raw: np.ndarray, offsets: np.ndarray):
    """Chunks of whole documents, few enough that counts stay small in memory."""
    for i, j in chunks(offsets, CHUNK // 2):
        for a in range(i, j, 256):
            b = min(j, a + 256)
            yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> dict[str, np.ndarray]:
    """A unit prototype for each language of the labelled rows.

    sample_docs bounds the labelled rows of each language, so the rarest one has
    its prototype, too: those with the smallest hashes of key and text are
    taken, the same ones on every run. Rows without a label or a text are left
    out; rows alike in key, text and label count once.
    """
    c = lambda n: F.col(f"`{n}`")
    rows = docs.where(c(lang).isNotNull() & c(text).isNotNull()).select(c(lang).cast("string").alias("lang"), c(text).cast("string").alias("text"), c(key).alias("k"))
    rows = rows.select("lang", "text", F.xxhash64("k").alias("h"), F.xxhash64("text").alias("t"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("h", "t"))
    # sample_docs lines for each language
    taken = landed(rows.select("lang", "h", "t").distinct().withColumn("n", place).where(F.col("n") <= sample_docs).drop("n"), "labelled")
    rows = rows.join(taken, ["lang", "h", "t"]).dropDuplicates(["lang", "h", "t"]).select("lang", "text")
    letters = letter_vectors()

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, off = text_column(batch, "text")
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for a, b, data, offs in _parts(raw, off):
                vec = bundle(data, offs, letters)
                norm = np.linalg.norm(vec, axis=1, keepdims=True)
                vec = vec / np.where(norm == 0, 1, norm)
                for name in set(langs[a:b]):
                    total[name] = total.get(name, 0) + vec[langs[a:b] == name].sum(axis=0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "v"])

    found: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(frugal(sums), "lang string, v array<double>").toLocalIterator():
        found[r[0]] = found.get(r[0], 0) + np.array(r[1])
    return {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if np.linalg.norm(v) > 0}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_id, cosine, margin for every row of docs.

    margin: how far the best cosine lies above the second. Nulls: a null text,
    and one without three letters and gaps in a row (such as an empty one), gets
    lang_id 'und' with null cosine and margin; a null key stays null. Ties go
    to the language that comes first in the alphabet. Repeated rows are
    answered each; whole texts count, however long; an empty table gives no rows.
    Other columns are ignored (detect() renames a key that clashes to <name>_in).
    """
    names = np.array([*prototypes, "und"], dtype=object)
    proto = np.stack(list(prototypes.values())).astype(np.float32) if prototypes else np.zeros((0, DIM), np.float32)
    rows = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("_text"))
    field = rows.schema.fields[0]
    letters = letter_vectors()

    def score(batches):
        for batch in batches:
            raw, off = text_column(batch, "_text")
            n = batch.num_rows
            best, cos, margin = np.full(n, len(proto)), np.full(n, np.nan), np.full(n, np.nan)
            for a, b, data, offs in _parts(raw, off):
                vec = bundle(data, offs, letters)
                norm = np.linalg.norm(vec, axis=1)
                if not len(proto):
                    continue
                sim = (vec @ proto.T) / np.where(norm == 0, 1, norm)[:, None]
                top = np.sort(sim, axis=1)
                some = norm > 0
                best[a:b][some] = sim.argmax(axis=1)[some]
                cos[a:b][some] = top[:, -1][some]
                margin[a:b][some] = (top[:, -1] - (top[:, -2] if len(proto) > 1 else 0))[some]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(cos, mask=np.isnan(cos)), pa.array(margin, mask=np.isnan(margin))], [field.name, "lang_id", "cosine", "margin"])

    out = f"`{field.name}` {field.dataType.simpleString()}, {OUT}"
    return rows.mapInArrow(frugal(score), out)


def detect(docs: DataFrame, **columns) -> DataFrame:
    """Fit the prototypes on docs' own labels (bounded sample), then identify all of docs."""
    docs = make_room(docs, ["lang_id", "cosine", "margin"])
    return identify(docs, fit(docs, **columns), **{k: v for k, v in columns.items() if k in ("text", "key")})
