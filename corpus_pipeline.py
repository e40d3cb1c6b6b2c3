"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage works on all documents that its predecessor kept, and takes and gives
a table that is written as Parquet in between. ORACLE_SQL is None: training a
factorization machine, graph search and subword encoding are beyond SQL, so the
tests hold the pipeline against brute-force versions instead.

Every stage handles nulls in any column, empty and very long texts, repeated
rows, ties, an empty table and further columns of any name as its operator says;
all but the last keep the columns of documents and hand extra ones on. A stage's
result is to be read before the same thread calls the next stage.
"""

from __future__ import annotations

import threading
from functools import wraps

from lodeworks.llm import mixing, pieces, repeats, simhash, toxicity
from lodeworks.llm.common import landed, mark, release, table

ORACLE_SQL = None
_SCRATCH = threading.local()


def _stage(f):
    """Delete what the stage before wrote for itself: its result is out by now."""

    @wraps(f)
    def run_stage(spark, docs, sf_dir):
        release(*_SCRATCH.__dict__.get("span", (0, 0)))
        start = mark()
        out = f(spark, docs, sf_dir)
        _SCRATCH.span = start, mark()
        return out

    return run_stage


@_stage
def toxicity_stage(spark, docs, sf_dir):
    """Documents that a factorization machine, trained on the labels, doesn't call toxic. A null or
    empty text is never toxic; rows alike share their fate."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rated = toxicity.rate(docs, machine)
    return rated.where("not toxic").drop("score", "toxic").toDF(*docs.columns)


@_stage
def near_dedup_stage(spark, docs, sf_dir):
    """One document of each group of near duplicates: the one with the smallest id
    (a null id first); of rows alike, one. Null and term-less texts all stay."""
    return simhash.drop_near_duplicates(docs)


@_stage
def repeats_stage(spark, docs, sf_dir):
    """Texts without the later copies of passages of 50 words or more; rows
    without words of their own go, null and empty texts stay."""
    return repeats.drop_repeats(docs)


@_stage
def mixing_stage(spark, docs, sf_dir):
    """Documents as often as the target weights of their sources ask for; a null
    language or source is a leaf of its own, empty texts come along."""
    return mixing.mix(docs, carry=True)


@_stage
def encoding_stage(spark, docs, sf_dir):
    """doc_id, lang, source, ids, n_ids, exact: the documents as token ids; a null text has null ids."""
    return pieces.tokenize(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]


def run(spark, sf_dir):
    """Apply STAGES to the documents; all but the last result are written to the shared folder and read again."""
    docs, written = table(spark, sf_dir, "documents"), (0, 0)
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        at = mark()
        docs = landed(result, name.replace(" ", "_"))
        release(*written)
        written = at, at + 1
    return STAGES[-1][1](spark, docs, sf_dir)
