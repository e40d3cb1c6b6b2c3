import time

import numpy as np
import pytest

from lodeworks.llm import caps, topk
from tests.llm.conftest import same


def table(spark, x, ids=None):
    rows = [(int(i), [float(a) for a in v], 5) for i, v in zip(range(len(x)) if ids is None else ids, x)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")


def brute_top(x, k):
    x = x.astype(np.float32).astype(np.float64)
    s = np.round(x @ x.T, 6) + 0.0
    out = []
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), -s[i])) if j != i][:k]
        out += [(i, r + 1, int(j), float(s[i, j])) for r, j in enumerate(order)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["lengths", "unit", "low rank", "ties"])
def test_top_k_equals_brute_force(spark, kind):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 12))
    if kind == "lengths":
        x *= rng.lognormal(0, 1.5, (150, 1))
    elif kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "low rank":
        x = rng.normal(size=(150, 2)) @ rng.normal(size=(2, 12))
    else:
        x = np.round(rng.normal(size=(150, 2)))
    got = topk.top_k(table(spark, x), k=5, block=32, group_bytes=4 * 12 * 64)
    assert [tuple(r[:3]) for r in same(got)] == [r[:3] for r in brute_top(x, 5)]
    assert np.allclose([r[3] for r in same(got)], [r[3] for r in brute_top(x, 5)], atol=2e-6)


def sides(x, block):
    """The whole of x as queries, and its blocks as items, by descending length."""
    x = x[np.argsort(-np.linalg.norm(x, axis=1), kind="stable")].astype(np.float32)
    _, axes = np.linalg.eigh(x.T.astype(np.float64) @ x)
    turn, ids = axes[:, ::-1].copy(), np.arange(len(x))
    return topk.Side(x, ids, turn), [topk.Side(x[a : a + block], ids[a : a + block], turn) for a in range(0, len(x), block)]


@pytest.mark.parametrize("kind, bounded, computed, axes", [("lengths", 0.26, 0.02, 64), ("low rank", 1.0, 0.02, 24), ("isotropic", 1.0, 0.02, 64)])
def test_pruning_leaves_little_to_compute(kind, bounded, computed, axes):
    """At the production block: the shares of all pairs that are bounded and computed, and the axes taken."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(8192, 64))
    if kind == "low rank":
        x = x * np.linspace(3, 0, 64).clip(0.02) ** 4
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        x *= rng.lognormal(0, 1.5, (len(x), 1))
    q, blocks = sides(x, topk.PRODUCTION["block"])
    best = topk.Best(len(x), 10)
    did = np.sum([topk.meet(best, q, b) for b in blocks], axis=0)
    assert did[0] <= bounded * len(x) ** 2 and did[1] <= computed * len(x) ** 2
    assert topk.chosen_cut(q, np.arange(len(x)), blocks[1], best.floor()) <= axes
    some = np.arange(0, len(x), 97)
    s = np.round(q.x[some].astype(np.float64) @ q.x.T.astype(np.float64), 6)
    s[np.arange(len(some)), some] = -np.inf
    assert np.allclose(best.score[some], -np.sort(-s, axis=1)[:, :10])


def test_only_blocks_within_reach_are_sent(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 8))
    x *= rng.lognormal(0, 2, (len(x), 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    rows = topk.usable(table(spark, x), "vec_id", "embedding")
    blocks = topk.packed_blocks(rows, 8, 3, 50, np.eye(8))
    sent, groups = topk.sent_blocks(blocks, 8, 50, 4 * 8 * 100)
    tops = {r.no: r.top for r in blocks.select("no", "top").collect()}
    need = {r.no: r.need for r in blocks.select("no", "need").collect()}
    each = -(-len(tops) // groups)
    least = {}
    for no, n in need.items():
        least[no // each] = min(n, least.get(no // each, np.inf))
    got = {(r["at"], r.no) for r in sent.where("kind = 1").select("at", "no").collect()}
    assert groups > 10 and got == {(g, no) for g, n in least.items() for no, t in tops.items() if t >= n}
    assert len(got) < 0.7 * groups * len(tops) and sent.where("kind = 0").count() == len(tops)
    assert [tuple(r[:3]) for r in same(topk.top_k(table(spark, x), k=3, block=50, group_bytes=4 * 8 * 100))] == [r[:3] for r in brute_top(x, 3)]


def test_huge_and_tiny_numbers(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4)) * 10.0 ** rng.integers(-20, 18, (60, 1))
    got = {tuple(r[:3]) for r in topk.top_k(table(spark, x), k=2, block=16).collect()}
    f = x.astype(np.float32).astype(np.float64)
    s = np.round(f @ f.T, 6)
    np.fill_diagonal(s, -np.inf)
    for i, _, j in got:
        assert np.isclose(s[i, j], np.sort(s[i])[-2:], rtol=1e-9, atol=2e-6).any()
    assert len(got) == 120


def test_top_k_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, None), (None, [1.0, 1.0]), (5, [1.0, 2.0, 3.0]), (6, []), (7, [1.0, None]), (8, [2.0, 0.0]), (8, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = same(topk.top_k(df, k=2, block=2))
    assert got == sorted([(1, 1, 8, 2.0), (1, 2, 8, 2.0), (2, 1, 1, 0.0), (2, 2, 8, 0.0), (8, 1, 1, 2.0), (8, 2, 2, 0.0), (8, 1, 1, 2.0), (8, 2, 2, 0.0)], key=repr)
    assert topk.top_k(df.limit(0)).count() == 0
    alike = spark.createDataFrame([(1, [1.0, 0.0])] * 6 + [(2, [0.5, 0.0])], "vec_id bigint, embedding array<float>")
    got = same(topk.top_k(alike, k=1, block=2))
    assert got == sorted([(1, 1, 2, 0.5)] * 6 + [(2, 1, 1, 0.5)], key=repr)


def brute_groups(x, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    root = np.arange(len(x))
    for i in range(len(x)):
        for j in range(i):
            if u[i] @ u[j] >= threshold:
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    return {(i, int(r)) for i, r in enumerate(root) if i != r}


def test_caps_find_near_duplicates(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 32))
    near = np.repeat(base[:60], 3, axis=0)
    near += 0.1 * rng.normal(size=near.shape) * np.linalg.norm(near, axis=1, keepdims=True) / 32**0.5
    x = np.concatenate([base, near, base[:5]])
    want = brute_groups(x, 0.95)
    got = set(map(tuple, caps.near_duplicates(table(spark, x)).collect()))
    assert len(want) > 150 and len(got & want) / len(want) >= 0.9 and not {k for k, _ in got} - {k for k, _ in want}


def test_list_decoding_equals_all_directions():
    rng = np.random.default_rng(3)
    code = caps.ProductCode(24, 5000, 12, 64, 1)
    x = rng.normal(size=(40, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, direction = code.decode(x)
    y = x @ code.turn
    parts = [y[:, a:b] @ c.T for (a, b), c in zip(zip(code.cuts[:-1], code.cuts[1:]), code.code)]
    total = parts[0]
    for p in parts[1:]:
        total = (total[:, :, None] + p[:, None, :]).reshape(len(x), -1)
    want = set()
    for i in range(len(x)):
        over = np.flatnonzero(total[i] >= code.alpha)
        want |= {(i, j) for j in (over if len(over) >= caps.LEAST else np.argsort(-total[i])[: caps.LEAST])}
    assert set(zip(row.tolist(), direction.tolist())) == want


def test_caps_edges(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 2), (3, [1.0, 0.0], 3), (None, [0.0, 1.0], 4), (9, [0.0, 1.0], 4), (4, [0.0, 0.0], 5), (5, None, 6), (6, [float("inf"), 0.0], 7), (7, [1.0, None], 1), (8, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, keep_id int")
    assert same(caps.near_duplicates(df)) == sorted([(2, 1), (3, 1), (9, None)], key=repr)
    assert caps.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [1_000_000, 10_000_000, 100_000_000])
def test_pairs_at_the_threshold_meet_at_any_row_count(rows):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(2, 600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + (1 - 0.95**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    code = caps.ProductCode(64, rows, 12, 64, 17)
    mine, other = ({(r, d) for r, d in zip(*code.decode(unit))} for unit in (x, y))
    assert len({r for r, _ in mine & other}) / len(x) >= 0.93


@pytest.mark.parametrize("part_rows", [7, 40, 100_000])
def test_crowded_caps_are_cut_without_loss(spark, part_rows):
    """300 noisy copies of one vector and loose ones, with parts of few vectors: the groups stay."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, np.repeat(base[:1], 300, 0) + 0.03 * rng.normal(size=(300, 16)), base[5:9] + 0.03 * rng.normal(size=(4, 16))])
    got = set(map(tuple, caps.near_duplicates(table(spark, x), part_bytes=4 * 16 * part_rows).collect()))
    assert got == brute_groups(x, 0.95) and len(got) >= 304


def test_fifty_thousand_copies_take_bounded_work():
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(1, 64)), 20_000, 0) + 0.01 * rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    names = rng.permutation(20_000)
    began = time.time()
    for split in (0, 9_000):
        e = caps.edges_of(names, x, 0.95, split)
        assert len(e) == 19_999 and len(set(e[:, 0].tolist())) == 1
    assert time.time() - began < 60


def test_edges_between_two_parts():
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(30, 5))] * 2) + 0.05 * rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = caps.edges_of(np.arange(60), x, 0.95, 30)
    near = x[:30] @ x[30:].T >= 0.95
    label = caps.union_find(np.stack(np.nonzero(near), 1) + [0, 30], 60)
    assert (caps.union_find(e, 60) == label).all()


def test_caps_equal_sql(spark):
    import duckdb

    rng = np.random.default_rng(11)
    base = rng.normal(size=(80, 16))
    x = np.concatenate([base, base[:20] + 0.05 * rng.normal(size=(20, 16)), base[:5]])
    con = duckdb.connect()
    con.sql("create table embeddings (vec_id bigint, embedding float[], label int)")
    con.executemany("insert into embeddings values (?, ?, 0)", [(i, [float(a) for a in v]) for i, v in enumerate(x)])
    assert same(caps.near_duplicates(table(spark, x))) == sorted(con.sql(caps.caps_sql()).fetchall(), key=repr)
