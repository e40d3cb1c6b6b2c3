import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.llm import repeats
from tests.llm.conftest import prose, same

L, K = 10, 4


def split(t):
    return re.findall(r"[\u3000-\u9fff]|[^ \t\n\r\f\v\u3000-\u9fff]+", t or "")


def brute(rows):
    where = defaultdict(set)
    for k, t in rows:
        w = split(t)
        for i in range(len(w) - L + 1):
            where[tuple(w[i : i + L])].add((k is not None, k or 0, t, i))
    later, first = defaultdict(set), defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            head = min(places)
            first[head[:3]].add(head[3])
            for p in places - {head}:
                later[p[:3]].add(p[3])

    def cover(starts):
        out = []
        for i in sorted(starts):
            if out and i <= out[-1][1]:
                out[-1][1] = i + L
            else:
                out.append([i, i + L])
        return out

    out = []
    for kind, flag in ((first, True), (later, False)):
        for (has, k, _), starts in kind.items():
            out += [(k if has else None, a, b, flag) for a, b in cover(starts - (later[(has, k, _)] if flag else set()))]
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    shared = [prose(rng, rng.randint(8, 40)) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randint(0, 30))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            parts += [rng.choice(shared), prose(rng, rng.randint(0, 12))]
        rows.append((i, "\n".join(parts)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (60, "da " * 200), (61, "da do " * 60), (62, ""), (63, None), (65, "中文字母語言學習 ab中文字母語言學習cd、" + "x"), (66, "前中文字母語言學習 ab中文字母語言學習cd、。"), (64, "too short"), (None, shared[0] + " " + prose(rng, 5))]
    return rows


def test_spans_equal_brute_force(spark, docs_of):
    for seed in (1, 2):
        rows = corpus(seed)
        assert same(repeats.spans(docs_of(rows), L, K).distinct()) == brute(rows)


@pytest.mark.parametrize("hot", [1, 4])
def test_hot_anchors_change_nothing(spark, docs_of, hot):
    rows = corpus(4)
    assert same(repeats.spans(docs_of(rows), L, K, hot_places=hot).distinct()) == brute(rows)


def test_spans_equal_sql(spark, docs_of):
    rows = [r for r in corpus(5) if r[0] is not None]
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.sql(repeats.spans_sql(L)).fetchall(), key=repr) == brute(rows)


def test_a_passage_in_very_many_documents(spark):
    """The anchors of a passage in 20,000 documents go by windows; no task holds them all."""
    passage = prose(random.Random(7), 60)
    docs = spark.range(20_000).selectExpr("id as doc_id", f"concat('a', id, ' b', id, ' {passage} c', id) as text", "1 as k", "'x' as head")
    got = repeats.spans(docs, 50, 16, hot_places=1000)
    by = {tuple(r): r["count"] for r in got.groupBy("start_word", "end_word", "first").count().select("start_word", "end_word", "first", "count").collect() for r in [r]}
    assert by == {(2, 62, True, 1): 1, (2, 62, False, 19_999): 19_999}


def test_very_long_text_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, 5, "x", 7), (2, long + " tail", 6, None, 8), (3, None, 1, "y", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, first int, h string, start_word int")
    assert same(repeats.spans(df)) == sorted([(1, 0, 60_000, True), (2, 0, 60_000, False)], key=repr)
    out = repeats.drop_repeats(df)
    assert out.columns == df.columns and same(out) == sorted([rows[0], (2, "tail", 6, None, 8), rows[2]], key=repr)


def test_later_copies_go(spark, docs_of):
    rows = corpus(3)
    df = docs_of(rows).withColumn("_cuts", F.lit(3))
    out = repeats.drop_repeats(df, L, K)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    cuts = defaultdict(list)
    for k, a, b, first in brute(rows):
        if not first:
            cuts[k].append((a, b))
    for k, t in rows:
        w = split(t)
        gone = {i for a, b in cuts.get(k, []) for i in range(a, b)}
        left = [x for i, x in enumerate(w) if i not in gone]
        if gone and not left:
            assert k not in got
        elif not gone:
            assert got[k].text == t
        else:
            assert split(got[k].text) == left
    again = [r for r in same(repeats.spans(out, 30, K)) if not r[3]]
    assert len(again) <= 2


def test_empty_and_repeated_rows(spark, docs_of):
    assert repeats.spans(docs_of([]), L, K).count() == 0 and repeats.drop_repeats(docs_of([]), L, K).count() == 0
    twice = docs_of([(1, prose(random.Random(0), 40))] * 2)
    assert repeats.spans(twice, L, K).where("not first").count() == 0


def test_borders_against_plain_comparison():
    rng = np.random.default_rng(0)
    for n in (2, 30, 400):
        m = max(1, n // 20)
        text = np.concatenate([np.append(rng.integers(m, m + 3, n // m), i) for i in range(m)])
        order, rank = repeats.suffix_order(text)
        tails = [tuple(text[i:]) for i in range(len(text))]
        assert sorted(range(len(text)), key=lambda i: tails[i]) == order.tolist()
        for least in (1, 3, 7):
            got = repeats.open_borders(text, order, rank, least)
            want = [False] + [tails[a][:least] == tails[b][:least] and min(len(tails[a]), len(tails[b])) >= least for a, b in zip(order, order[1:])]
            assert got.tolist() == want


def test_every_window_has_its_anchor():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 4, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = np.array([0, 5, 100, 300])
    at, gram = repeats.anchors(h, first, L, K)
    for a, b in zip(first[:-1], first[1:]):
        for i in range(a, b - L + 1):
            inside = range(i, i + L - K + 1)
            low = min(gram[j] for j in inside)
            assert any(gram[j] == low for j in at if j in inside)
