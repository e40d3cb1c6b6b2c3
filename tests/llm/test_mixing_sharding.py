import hashlib
import random
import re

import duckdb
import pytest

from lodeworks.llm import mixing, sharding
from tests.llm.conftest import prose, same

SHOWN = ["doc_id", "epoch", "domain", "lang", "source", "n_tokens"]


def rows_of(seed=0, n=400):
    rng = random.Random(seed)
    out = [(i, prose(rng, rng.choice([0, 3, 20, 200])), rng.choice(["en", "en", "de", "fr", None]), rng.choice(["src0", "src0", "src1", "src2", "src7", "web", None]), 5) for i in range(n)]
    return [*out, (None, "null key here", "en", "src0", None), (3, None, "en", "src0", 1), (4, "", "xx", "src9", 1), out[7], out[7], (n, prose(rng, 9000), "es", "src5", 1)]


def by_sql(rows, sql):
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    if rows:
        con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


@pytest.mark.parametrize("changes", [{}, {"budget_share": 0.3, "max_epochs": 1}, {"budget_share": 2.5, "max_epochs": 4, "source_weights": {"src0": 9, "web": 0}}, {"budget_share": 0.0}, {"budget_share": 50, "max_epochs": 2}])
def test_mix_equals_sql(spark, docs_of, changes):
    rows = rows_of()
    cols, want = by_sql(rows, mixing.mixing_sql(**changes))
    at = [cols.index(c) for c in SHOWN]
    assert same(mixing.mix(docs_of(rows), **changes).select(SHOWN)) == sorted((tuple(r[i] for i in at) for r in want), key=repr)


def water(budget, children):
    """Shares of a budget by weight, none above its capacity: raise the level until it is spent. children: name -> (weight, capacity)."""
    got, open_ = {}, dict(children)
    while open_:
        weight = sum(w for w, _ in open_.values())
        full = [n for n, (w, cap) in open_.items() if w and budget * w >= cap * weight]
        if not full:
            break
        n = min(full, key=lambda n: (open_[n][1] / open_[n][0], n))
        got[n] = open_.pop(n)[1]
        budget -= got[n]
    weight = sum(w for w, _ in open_.values())
    return got | {n: min(cap, budget * w // weight) if w else 0 for n, (w, cap) in open_.items()}


@pytest.mark.parametrize("share, epochs, sources", [(0.8, 2, {}), (0.3, 1, {"src0": 9, "web": 0}), (1.7, 3, {"src1": 5})])
def test_budgets_by_brute_force(spark, docs_of, share, epochs, sources):
    """Every leaf's budget by plain water filling down the tree, and its documents by plain sorting."""
    rows = list({r[0]: r for r in rows_of(5) if r[0] is not None}.values())
    p = mixing.PRODUCTION
    leaves = {}
    for key, text, lang, source, _ in rows:
        tail = re.search("([0-9]+)$", source or "")
        leaves.setdefault((f"d{int(tail[1]) % 4 if tail else 0}", lang or "", source or ""), []).append((key, len((text or "").split())))
    cap = {leaf: epochs * sum(n for _, n in docs) for leaf, docs in leaves.items()}
    under = lambda *head: sum(c for leaf, c in cap.items() if leaf[: len(head)] == head)
    total = sum(cap.values()) // epochs * round(share * 10**6) // 10**6
    budget = {}
    for d, a in water(total, {d: (p["domain_weights"].get(d, 1), under(d)) for d, _, _ in leaves}).items():
        for g, b in water(a, {g: (p["lang_weights"].get(g, 1), under(d, g)) for x, g, _ in leaves if x == d}).items():
            for s, c in water(b, {s: (sources.get(s, 1), cap[d, g, s]) for x, y, s in leaves if (x, y) == (d, g)}).items():
                budget[d, g, s] = c
    want = []
    for leaf, docs in leaves.items():
        size = sum(n for _, n in docs)
        left = budget[leaf]
        for epoch in range(epochs + 1):
            if epoch < (left // size if size else 0):
                want += [(key, epoch) for key, _ in docs]
                continue
            run, rest = 0, left % size if size else 0
            for key, n in sorted(docs, key=lambda d: (hashlib.md5(f"{p['seed']}:{epoch}:{d[0]}".encode()).hexdigest(), d[0])):
                run += n
                if run > rest:
                    break
                want.append((key, epoch))
            break
    got = mixing.mix(docs_of(rows), budget_share=share, max_epochs=epochs, source_weights=sources).select("doc_id", "epoch")
    assert same(got) == sorted(want, key=repr)


def test_rows_alike_but_for_their_text_are_taken_alike_on_every_run(spark, docs_of):
    rows = [(1, f"{a} {b} {c}", "en", "src0", i) for i, (a, b, c) in enumerate([("x", "y", "z"), ("k", "l", "m"), ("p", "q", "r"), ("s", "t", "u")] * 3)]
    a, b = (same(mixing.mix(docs_of(part), carry=True, budget_share=0.4).select("text")) for part in (rows, rows[::-1]))
    assert a == b and 0 < len(a) < len(rows)


def test_mix_carries_whole_rows(spark, docs_of):
    rows = rows_of(2)
    df = docs_of(rows).withColumnRenamed("n_chars", "epoch")
    out = mixing.mix(df, carry=True)
    assert out.columns == df.columns
    assert same(out.select("doc_id")) == same(mixing.mix(docs_of(rows)).select("doc_id"))
    assert mixing.mix(docs_of([])).count() == 0


@pytest.mark.parametrize("shard_bytes", [500, 5_000, 10**9])
def test_shards_equal_sql(spark, docs_of, shard_bytes):
    rows = [(i * 37 % 1009 - 300, *r[1:]) for i, r in enumerate(rows_of(3)) if r[0] is not None] + [(None, "null key", "en", "s", 1), (None, None, None, None, None)]
    out = sharding.histogram_sort(docs_of(rows), shard_bytes=shard_bytes)
    cols, want = by_sql(rows, sharding.sharding_sql(shard_bytes))
    at = [cols.index(c) for c in out.columns]
    got = out.collect()
    assert sorted(map(tuple, got), key=repr) == sorted((tuple(r[i] for i in at) for r in want), key=repr)
    keys = [(r.shard, r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)


@pytest.mark.parametrize("shard_bytes, coarse", [(500, 3), (60, 16), (5_000, 2)])
def test_cuts_counted_in_cells_equal_sql(spark, docs_of, shard_bytes, coarse):
    rows = [(i * 37 % 1009 - 300, *r[1:]) for i, r in enumerate(rows_of(4)) if r[0] is not None] + [(None, "null key " * 40, "en", "s", 1)]
    rows += [(5, "w" * 4000, "en", "s", 1)] * 2
    out = sharding.histogram_sort(docs_of(rows), shard_bytes=shard_bytes, coarse=coarse)
    cols, want = by_sql(rows, sharding.sharding_sql(shard_bytes))
    at = [cols.index(c) for c in out.columns]
    assert same(out) == sorted((tuple(r[i] for i in at) for r in want), key=repr)


def test_shards_keep_keys_together_within_tolerance(spark, docs_of):
    rng = random.Random(1)
    rows = [(rng.randrange(10**12), "x" * rng.randint(1, 50), None, None, None) for _ in range(800)] + [(77, "y" * 3000, None, None, None)] * 2
    out = sharding.histogram_sort(docs_of(rows), shard_bytes=1000, tolerance=0.1).collect()
    total = sum(len(r[1]) for r in rows)
    n = -(-total // 1000)
    size, shard_of = {}, {}
    for r in out:
        size[r.shard] = size.get(r.shard, 0) + len(r.text)
        assert shard_of.setdefault(r.doc_id, r.shard) == r.shard
    ends = [sum(v for s, v in size.items() if s <= i) for i in range(max(size))]
    for e in ends:
        nearest = min(abs(e - i * total / n) for i in range(1, n))
        assert nearest <= 0.1 * total / n + 6000
    assert sharding.histogram_sort(docs_of([]), shard_bytes=10).count() == 0
    assert sharding.histogram_sort(docs_of(rows).withColumnRenamed("lang", "shard"), shard_bytes=1000).columns == ["doc_id", "text", "shard_in", "source", "n_chars", "shard"]
