import random

import numpy as np
import pytest

from lodeworks.llm import pieces
from tests.llm.conftest import prose

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    return pieces.Model.load(pieces.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def texts(n=300):
    rng = random.Random(4)
    bits = ["a", "the", "  ", " ", "\n", "\t", "é", "中", "🙂", "▁", "in", "er", "09", '"', " " * 20, "-----", "\0", prose(rng, 4)]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*out, "", "x" * 3000, " " * 200, "".join(rng.choice("abcdefinotr") for _ in range(9000)), "ab▁c"]


def test_ids_equal_the_library(model, library):
    for t in texts():
        assert model.encode(t) == library.encode(t)


def test_stream_window_and_batch_agree(model):
    segs = sorted({s for t in texts() for s in model.segments(model.normalized(t)) if len(s) <= 64})
    for s, ids in zip(segs, model.windows(segs)):
        assert tuple(np.frombuffer(ids, np.int32).tolist()) == model.ids_of(model.window(s)) == model.ids_of(model.stream(s))


def test_ids_leave_before_the_text_ends(model):
    """The stream commits while characters still come, and holds a bounded window."""
    seen = []

    def chars():
        for i in range(5000):
            seen.append(i)
            yield "abcdefinotr"[(i * 7 + i // 3) % 11]

    gen = model.stream(chars())
    next(gen)
    assert len(seen) < 20 * model.longest


def test_unigram_paths_are_optimal(model):
    """A unigram model over the same pieces: total scores as good as any path's."""
    rng = random.Random(2)
    m = pieces.Model.load(pieces.MODEL)
    m.type = pieces.UNIGRAM
    m.score = [-3 - rng.random() * 9 for _ in m.score]

    def best(t):
        top = [0.0] + [-np.inf] * len(t)
        for e in range(1, len(t) + 1):
            for s in range(max(0, e - m.longest), e):
                at = m.index.get(t[s:e])
                gain = m.score[at] if at is not None else m.unk_score if e - s == 1 else -np.inf
                top[e] = max(top[e], top[s] + gain)
        return top[-1]

    for t in [prose(rng, 12).replace(" ", "▁"), "x" * 400, "中a" * 30]:
        for path in (list(m.stream(t)), m.window(t)):
            assert "".join(path) == t
            total = sum(m.score[m.index[p]] if p in m.index else m.unk_score for p in path)
            assert total == pytest.approx(best(t))


def test_tokenize_and_back(spark):
    rows = [(i, t, "keep") for i, t in enumerate(texts(40))] + [(None, "null key", None), (77, None, None), (78, "same", "a"), (78, "same", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = pieces.tokenize(df, keep=("doc_id", "ids"))
    assert out.columns == ["doc_id", "ids_in", "ids", "n_ids", "exact"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id == 77:
            assert r.ids is None and r.n_ids is None and r.exact
        else:
            assert r.n_ids == len(r.ids)
    assert all(r.exact for r in got if r.doc_id is not None and r.doc_id < 40 and "▁" not in rows[r.doc_id][1])
    back = pieces.detokenize(out)
    for r in back.where("exact and doc_id < 40").collect():
        assert r.text == rows[r.doc_id][1]
    assert back.where("ids is null").first().text is None
    assert pieces.tokenize(df.limit(0)).count() == 0
