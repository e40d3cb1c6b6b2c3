import random

import pytest

import corpus_pipeline
from lodeworks.llm import pieces, queries, simhash
from tests.llm import test_repeats, test_simhash
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(9)
    rows, labels = [], []
    passage = prose(rng, 60)
    for i in range(160):
        toxic = i % 4 == 0
        text = prose(rng, rng.randint(20, 90)) + (" vermin scumbag" if toxic else "")
        if i % 10 == 3:
            text = passage + " " + text
        rows.append((i, text, rng.choice(["en", "de"]), f"src{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(200 + j, rows[j][1] + " extra", "en", "src0", 1) for j in (1, 5, 9)] + [(300, None, "en", "src1", None), (301, "", None, None, 0), (None, "no key here at all", "en", "src1", 18)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_one_by_one(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = docs.collect()
        seen.append(name)
        if i < 4:
            assert docs.columns == names
        if name == "toxicity":
            assert {r.doc_id for r in after} == {r.doc_id for r in before if "vermin" not in (r.text or "")}
        elif name == "simhash near-dedup":
            gone = {k for k, _ in test_simhash.brute([(r.doc_id, r.text) for r in before])}
            assert {201, 205, 209} <= gone and sorted((r.doc_id for r in after), key=repr) == sorted((r.doc_id for r in before if r.doc_id not in gone), key=repr)
        elif name == "suffix-array dedup":
            old = test_repeats.L
            test_repeats.L = 50
            later = {k for k, _, _, first in test_repeats.brute([(r.doc_id, r.text) for r in before]) if not first}
            test_repeats.L = old
            text = {r.doc_id: r.text for r in before}
            assert later and {r.doc_id for r in after if r.text != text[r.doc_id]} == later
            assert all(r.n_chars == len(r.text) for r in after if r.doc_id in later)
        elif name == "mixing":
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        else:
            model = pieces.Model.load(pieces.MODEL)
            text = {r.doc_id: r.text for r in before}
            assert len(after) == len(before) and all(r.ids == (None if text[r.doc_id] is None else model.encode(text[r.doc_id])) for r in after)
    assert len(seen) == 5


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_ids", "exact"] and out.count() > 50
    assert corpus_pipeline.ORACLE_SQL is None


def test_names():
    import re

    found = {int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()}
    assert found == set(range(1, 11)) and set(queries.oracle_sql()) <= set(queries.queries())


def test_near_dedup_of_a_crowd_takes_few_candidates(spark, docs_of, monkeypatch):
    rows = list(enumerate(test_simhash.crowd(random.Random(23), 100, 700, 4)))
    tables, landed = {}, simhash.landed
    monkeypatch.setattr(simhash, "landed", lambda df, name: tables.update({name: landed(df, name)}) or tables[name])
    left = [r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs_of(rows), "").collect()]
    assert tables["candidates"].count() < 60 * len(rows)  # a quarter of a million pairs
    gone = {k for k, _ in test_simhash.brute_by_term(rows)}
    assert sorted(left) == [k for k, _ in rows if k not in gone]
