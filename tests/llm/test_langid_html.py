import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from lodeworks.llm import htmltext, langid
from tests.llm.conftest import same

SYLLABLES = {"aa": "ba be bi bo ka ke".split(), "bb": "shtr krz vls ptk".split(), "cc": "éau çon ère île".split(), "zh": "中文 字母 語言 學習".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy(spark):
    rng = random.Random(0)
    rows = [(i, text(rng, lang, rng.randint(4, 60)), lang) for i, lang in enumerate(["aa", "bb", "cc", "zh"] * 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    proto = langid.fit(df.where("doc_id < 120"))
    assert sorted(proto) == ["aa", "bb", "cc", "zh"]
    got = {r.doc_id: r.lang_id for r in langid.identify(df.where("doc_id >= 120"), proto).collect()}
    assert len(got) == 120 and sum(got[i] == lang for i, _, lang in rows[120:]) >= 118


def test_bundle_equals_plain_sums():
    letters = langid.letter_vectors(64)
    texts = ["ba bo", "Éau, çon!", "", "x", "ab  12 ab"]
    raw = "".join(texts).encode()
    off = np.cumsum([0, *[len(t.encode()) for t in texts]])
    got = langid.bundle(np.frombuffer(raw, np.uint8), off, letters)
    for i, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        s, _ = langid.symbols(data, np.array([0, len(data)]))
        want = np.zeros(64)
        for a, b, c in zip(s, s[1:], s[2:]):
            if b:
                want += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        assert np.allclose(got[i], want)


def test_langid_edges(spark):
    rows = [(1, None, "aa"), (2, "", "aa"), (3, "ba be bi bo ka ke", "aa"), (3, "ba be bi bo ka ke", "aa"), (4, "éau çon " * 60_000, "cc"), (None, "ère île çon éau", "cc"), (5, "1 2 3", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 as cosine", "2 as lang_id")
    got = same(langid.detect(df).select("doc_id", "lang_id"))
    assert got == sorted([(1, "und"), (2, "und"), (3, "aa"), (3, "aa"), (4, "cc"), (None, "cc"), (5, "und")], key=repr)
    assert langid.detect(df.limit(0)).count() == 0
    assert same(langid.identify(df.where("doc_id = 3"), {}).select("lang_id").distinct()) == [("und",)]


PARA = "The first sentence is long enough, clearly. The second one adds more words; it has marks, too. A third closes it."
PAGE = f"""<!DOCTYPE html><html><head><title>T, t. t!</title><style>p{{}}</style><script>var a="<p>no. no, no.</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><!-- <p>hidden. text, here.</p> -->
<article><h1>Head</h1><p>{PARA}<p>{PARA} &amp; <b>bold, too.</b></p><p>{PARA}</p></article>
<div class="x"><a href='q>r'>more</a></div><footer>(c) 2020</footer></body></html>"""


def test_main_text():
    got, kept, total = htmltext.main_text(PAGE)
    assert got.count(PARA) == 3 and "& bold, too." in got
    assert not any(x in got for x in ("Home", "hidden", "no. no", "T, t", "(c)"))
    assert 0 < kept < total


def test_scores_by_hand():
    texts, paths = ["ab. c,", "x", "x", "long text, here. ok."], [1, 2, 2, 1]
    size, mark = {1: ((6 + 20) / 2) ** 0.5, 2: 1.0}, {1: (2 + 3) ** 0.5 / 2**0.5, 2: 0.0}
    k = htmltext.SMOOTH
    fused = []
    for i in range(4):
        near = [(k[j + 1], paths[i + j]) for j in (-1, 0, 1) if 0 <= i + j < 4]
        w = sum(a for a, _ in near)
        fused.append(sum(a * size[p] for a, p in near) / w * sum(a * mark[p] for a, p in near) / w)
    want = {p: np.mean([f for f, q in zip(fused, paths) if q == p]) for p in (1, 2)}
    assert htmltext.path_scores(texts, paths) == pytest.approx([want[p] for p in paths])


def test_html_edges(spark):
    deep = "<div>" * 20_000 + "deep, text. here" + "</div>" * 10
    bad = ["<p", "<<<>>>", "a<b", "<p>one, two.<p>three", "</p></p>", "<script>never closed <p>x, y.", "<a href=\"" + "x" * 50_000, "&#x110000;&bogus;", deep, "x" * 300_000]
    rows = [(1, None, "t"), (2, "", None), (3, PAGE, "t"), (3, PAGE, "t"), (None, "<p>just, this.</p>", "t")] + [(10 + i, b, None) for i, b in enumerate(bad)]
    df = spark.createDataFrame(rows, "page_id bigint, html string, text string")
    got = htmltext.extract(df)
    assert got.columns == ["page_id", "text", "kept_nodes", "all_nodes"] and got.count() == len(rows)
    by = {r.page_id: r for r in got.collect()}
    assert by[1].text is None and by[1].all_nodes == 0 and by[2].text == "" and by[None].text == "just, this."
    assert by[13].text == "one, two.\nthree" or by[13].text == "one, two." and by[18].text.startswith("deep")
    assert htmltext.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("quote", ['"', "'"])
def test_long_attributes_are_no_text(quote):
    data = "{a: 1, b>2. c; <p>d!</p>} " * 4000
    body = "".join(f"<p>{PARA}</p>" for _ in range(40))
    got, _, total = htmltext.main_text(f"<html><body><div data-props={quote}{data}{quote}></div><article>{body}</article></body></html>")
    assert len(data) > 100_000 and total == 40 and got.split("\n") == [PARA] * 40


class Plain(HTMLParser):
    """Text nodes of a well-nested page by a library's parser: text, path of tags, block."""

    def __init__(self):
        super().__init__()
        self.path, self.nodes, self.block = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.block += tag not in htmltext._INLINE or tag == "br"
        if tag not in htmltext._VOID:
            self.path.append(tag)

    def handle_endtag(self, tag):
        self.block += tag not in htmltext._INLINE
        assert self.path.pop() == tag

    def handle_data(self, data):
        if data.strip():
            self.nodes.append((" ".join(("_" + data + "_").split())[1:-1], "/".join(self.path), self.block))


def plain_text(page):
    """The whole extraction by plain loops."""
    reader = Plain()
    reader.feed(page)
    nodes = reader.nodes
    if not nodes:
        return "", 0, 0
    marks = lambda t: sum(c in ".,;:!?" for c in t)
    by = {}
    for t, p, _ in nodes:
        by.setdefault(p, []).append(t)
    size = {p: (sum(map(len, ts)) / len(ts)) ** 0.5 for p, ts in by.items()}
    mark = {p: (sum(map(marks, ts)) / len(ts)) ** 0.5 for p, ts in by.items()}
    fused = {}
    for i, (_, p, _) in enumerate(nodes):
        near = [(w, nodes[i + j][1]) for j, w in zip((-1, 0, 1), htmltext.SMOOTH) if 0 <= i + j < len(nodes)]
        total = sum(w for w, _ in near)
        fused.setdefault(p, []).append(sum(w * size[q] for w, q in near) / total * sum(w * mark[q] for w, q in near) / total)
    score = [sum(fused[p]) / len(fused[p]) for _, p, _ in nodes]
    cut = htmltext.SPREAD * np.std(score)
    assert np.std(score) < 1e-9 or min(abs(s - cut) for s in score) > 1e-9
    parts, last = [], None
    for (t, _, b), s in zip(nodes, score):
        if s >= cut:
            if b == last:
                parts[-1] += t
            else:
                parts.append(t)
            last = b
    return "\n".join(p.strip() for p in parts if p.strip()), sum(s >= cut for s in score), len(nodes)


def test_extraction_equals_plain_loops_on_random_trees():
    rng = random.Random(4)

    def words():
        return " ".join(rng.choice(["alpha", "beta, gamma.", "delta!", "x", "long sentence, with marks; here."]) for _ in range(rng.randint(1, 12)))

    def tree(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.45 or depth > 5:
                out.append(words())
            elif kind < 0.55:
                out.append(rng.choice(["<br>", "<!-- no, <b> -->", "<hr>", "<img alt='a>b' src=x>"]))
            else:
                tag = rng.choice(["div", "section", "b", "span", "em", "article", "ul", "h2"])
                attrs = rng.choice(["", " class=a", " title=\"it's > that\"", " data-x='{\"a\": 1}'"])
                out.append(f"<{tag}{attrs}>{tree(depth + 1)}</{tag}>")
        return rng.choice([" ", "\n", ""]).join(out)

    seen = 0
    for _ in range(300):
        page = f"<html><body>{tree(0)}</body></html>"
        got = htmltext.main_text(page)
        assert got == plain_text(page)
        seen += 0 < got[1] < got[2]
    assert seen > 40


@pytest.mark.parametrize("page", ["<a " * 1_700_000, '"' * 5_000_000, '<a ="' * 1_000_000, "<ul><li>x" * 200_000, "<ul><li>" + "<div>" * 150_000 + "</i><li></li>" * 100_000, "<" * 5_000_000, "<a ='>'" * 200_000 + '="', "<b>a, b</b>" * 200_000])
def test_hostile_pages_take_linear_time(page):
    began = time.time()
    htmltext.main_text(page)
    assert time.time() - began < 20


def test_a_value_of_a_megabyte_leaks_nothing_and_heads_may_stay_open():
    assert htmltext.main_text(f'<p title="{"a > b, c. " * 100_000}">{PARA}</p>')[0] == PARA
    assert htmltext.main_text(f"<html><head><title>T</title><meta charset=x><p>{PARA}")[0] == PARA
    assert htmltext.main_text(f"<p>{PARA}<a title='it's'>x</a></p><p>don't, stop.</p>")[2] == 3
