import random

import numpy as np

from lodeworks.llm import toxicity
from tests.llm.conftest import prose, same


def labelled(seed=0, n=500):
    """Toxic: an insult together with a group; either alone is not."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        text = prose(rng, rng.randint(5, 60)) + (" vermin" if insult else "") + (" gruppistan" if group else "")
        docs.append((i, text))
        labels.append((i, int(insult and group)))
    return docs, labels


def test_pairs_are_learned_on_held_out_texts(spark, docs_of):
    docs, labels = labelled()
    machine = toxicity.fit(docs_of(docs), spark.createDataFrame(labels[:350], "doc_id bigint, toxic int"))
    got = {r.doc_id: r.toxic for r in toxicity.rate(docs_of(docs).select("doc_id", "text"), machine).collect()}
    held = labels[350:]
    assert sum(got[i] == bool(y) for i, y in held) / len(held) >= 0.95


def buckets_of(draw, n, seed):
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for _ in range(n):
        marks, toxic = draw(rng)
        texts.append(np.unique([*marks, *rng.integers(10, 400, rng.integers(5, 60))]).astype(np.int32))
        labels.append(float(toxic))
    return texts, np.array(labels)


def held_out(texts, labels, cut):
    m = toxicity.train(texts[:cut], labels[:cut])
    rest = texts[cut:]
    doc = np.repeat(np.arange(len(rest)), [len(t) for t in rest])
    z = m.logits(*m.active(np.concatenate(rest), doc), len(rest))
    return 1 / (1 + np.exp(-z)) >= m.cut, labels[cut:] == 1


def test_a_pure_interaction_is_learned():
    """Toxic: exactly one of two terms. Either alone says nothing."""

    def draw(rng):
        a, b = rng.random(2) < 0.5
        return [i for i, x in enumerate((a, b)) if x], a != b

    got, want = held_out(*buckets_of(draw, 4000, 0), 2800)
    assert (got == want).mean() >= 0.95


def test_a_rare_word_that_is_toxic_beside_a_group_only():
    def draw(rng):
        group, word, slur = rng.random() < 0.2, rng.random() < 0.02, rng.random() < 0.1
        return [i for i, x in enumerate((group, word)) if x] + [2 + rng.integers(4)] * slur, slur or group and word

    texts, labels = buckets_of(draw, 16_000, 1)
    got, want = held_out(texts, labels, 11_000)
    both = np.array([0 in t and 1 in t for t in texts[11_000:]])
    assert both.sum() > 10 and got[both].mean() >= 0.9 and got[~want].mean() < 0.01 and got[want].mean() > 0.97


def test_partners_equal_plain_counting():
    rng = np.random.default_rng(2)
    texts = [np.unique(rng.integers(0, 30, 8)) for _ in range(600)]
    label = np.array([float((3 in t) != (4 in t) or 7 in t and 8 in t) for t in texts])
    p = rng.uniform(0.2, 0.6, 600)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = {tuple(r) for r in toxicity.partners(np.concatenate(texts), first, label, p, 12.0).tolist()}
    want = set()
    for i in range(30):
        for j in range(i + 1, 30):
            at = [k for k, t in enumerate(texts) if i in t and j in t]
            n, o, e = len(at), label[at].sum(), p[at].sum()
            g = 2 * ((o * np.log(o / e) if o else 0) + ((n - o) * np.log((n - o) / (n - e)) if n > o else 0)) if at else 0
            if g >= 12:
                want.add((i, j, int(np.sign(o - e))))
    assert len(want) > 3 and got == want


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    texts = [np.unique(rng.integers(0, 12, 5)) for _ in range(40)]
    flat, first = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    y, weight = rng.integers(0, 2, 40).astype(float), rng.random(40)

    def loss(m):
        doc = np.repeat(np.arange(40), np.diff(first))
        z = m.logits(doc, flat, 40)
        return (weight * (np.log1p(np.exp(z)) - y * z)).sum()

    m = toxicity.Machine(np.zeros(1, np.int32), rng.normal(size=12), rng.normal(size=(12, 3)), 0.2, 0.5)
    err, total = toxicity.gradient(m, flat, first, y, weight)
    doc = np.repeat(np.arange(40), np.diff(first))
    for t in range(12):
        for k in range(3):
            want = 0.0
            for sign in (1, -1):
                m.v[t, k] += sign * 1e-5
                want += sign * loss(m) / 2e-5
                m.v[t, k] -= sign * 1e-5
            on = flat == t
            assert abs((err[doc[on]] * (total[doc[on], k] - m.v[t, k])).sum() - want) < 1e-5


def test_keys_that_repeat_count_once(spark):
    docs, labels = labelled(2, 200)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    many = df.unionByName(df.where("doc_id = 3").selectExpr("doc_id", "explode(sequence(1, 500)) as i", "text").drop("i"))
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    a, b = toxicity.fit(df, known), toxicity.fit(many, known)
    assert np.allclose(a.w, b.w) and a.cut == b.cut


def test_edge_cases(spark):
    docs, labels = labelled(1)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    machine = toxicity.fit(df, spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1), labels[5]], "doc_id bigint, toxic int"))
    odd = spark.createDataFrame([(1, None, 5, "x"), (2, "", 6, None), (3, "vermin gruppistan", 7, "y"), (3, "vermin gruppistan", 7, "y"), (4, "VERMIN, Gruppistan! " + "filler " * 50_000, 8, None), (None, "words", 1, None)], "doc_id bigint, text string, score int, toxic string")
    got = toxicity.rate(odd, machine)
    assert got.columns == ["doc_id", "text", "score_in", "toxic_in", "score", "toxic"]
    flags = [(r.doc_id, r.toxic) for r in got.collect()]
    assert sorted(flags, key=repr) == sorted([(1, False), (2, False), (3, True), (3, True), (4, True), (None, False)], key=repr)


def test_no_labels_and_one_class(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    for rows in ([], [(1, 0)]):
        machine = toxicity.fit(df, spark.createDataFrame(rows, "doc_id bigint, toxic int"))
        assert same(toxicity.rate(df, machine).select("toxic")) == [(False,)]
    machine = toxicity.fit(df.limit(0), spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int"))
    assert toxicity.rate(df.limit(0), machine).count() == 0


def test_scores_equal_the_formula():
    rng = np.random.default_rng(0)
    place = np.full(1 << toxicity.BUCKET_BITS, -1, np.int32)
    data = np.frombuffer(b"vermin gruppistan table", np.uint8)
    off = np.array([0, 17, 23])
    b, doc = toxicity.buckets(data, off)
    for i, x in enumerate(np.unique(b)):
        place[x] = i
    m = toxicity.Machine(place, rng.normal(size=len(np.unique(b))), rng.normal(size=(len(np.unique(b)), 3)), 0.3, 0.5)
    for d in range(2):
        t = np.unique(place[b[doc == d]])
        z = 0.3 + m.w[t].sum() + sum(m.v[i] @ m.v[j] for k, i in enumerate(t) for j in t[k + 1 :])
        assert abs(m.scores(data, off)[d] - 1 / (1 + np.exp(-z))) < 1e-9
