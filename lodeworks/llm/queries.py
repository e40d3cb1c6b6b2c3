"""The queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from lodeworks.llm import caps, htmltext, langid, mixing, pieces, repeats, sharding, simhash, topk, toxicity
from lodeworks.llm.common import table

SHARD_BYTES = 32 << 20


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.rate(docs.select("doc_id", "text"), machine).drop("text")


def op3_sentencepiece(spark, sf_dir):
    return pieces.tokenize(table(spark, sf_dir, "documents"))


def op4_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), **topk.PRODUCTION)


def op5_html(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_caps(spark, sf_dir):
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"), **caps.PRODUCTION)


def op8_langid(spark, sf_dir):
    return langid.detect(table(spark, sf_dir, "documents"))


def op9_sharding(spark, sf_dir):
    return sharding.histogram_sort(table(spark, sf_dir, "documents"), shard_bytes=SHARD_BYTES)


def op10_suffix_dedup(spark, sf_dir):
    return repeats.spans(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict:
    return {
        "op1_simhash": simhash.groups_sql(simhash.PRODUCTION["jaccard"]),
        "op4_topk": topk.topk_sql(topk.PRODUCTION["k"]),
        "op6_mixing": mixing.mixing_sql(),
        "op7_caps": caps.caps_sql(caps.PRODUCTION["threshold"]),
        "op9_sharding": sharding.sharding_sql(SHARD_BYTES),
        "op10_suffix_dedup": repeats.spans_sql(),
    }
