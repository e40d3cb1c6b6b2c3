import random

import pytest
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lodeworks.errors import InvalidInput
from lodeworks.operators import cdc, changelog
from tests.conftest import rows

ROW = StructType([StructField("k", IntegerType()), StructField("a", StringType()), StructField("b", StringType())])
PK = ["k"]


def events(spark, items):
    """items: (op, before, after, masked) in order; one transaction each."""
    return spark.createDataFrame([(i + 1, i, 0, 0, op, b, a, list(m)) for i, (op, b, a, m) in enumerate(items)], cdc.event_schema(ROW))


def table(spark, data):
    return spark.createDataFrame(data, ROW)


def replay(data, items):
    """The truth: apply the events one by one."""
    state = {r[0]: list(r) for r in data}
    for op, before, after, masked in items:
        if op == "T":
            state = {}
        elif op == "D":
            state.pop(before[0], None)
        else:
            old = state.get(before[0] if before else after[0])
            new = list(after)
            for i, c in enumerate("kab"):
                if c in masked:
                    new[i] = old[i]
            if before and before[0] != after[0]:
                state.pop(before[0], None)
            state[after[0]] = new
    return sorted((tuple(r) for r in state.values()), key=repr)


def random_window(rng, state, n, masks=True, moves=True, truncates=True):
    keys, out = set(state), []
    for i in range(n):
        what = rng.random()
        if what < 0.03 and truncates:
            out.append(("T", None, None, ()))
            keys.clear()
        elif what < 0.2 and keys:
            k = rng.choice(sorted(keys))
            keys.discard(k)
            out.append(("D", (k, None, None), None, ()))
        elif what < 0.55 and keys:
            k = rng.choice(sorted(keys))
            m = ("b",) if masks and rng.random() < 0.4 else ()
            out.append(("U", (k, None, None), (k, f"u{i}", None if m or rng.random() < 0.1 else f"v{i}"), m))
        elif what < 0.7 and keys and moves:
            k = rng.choice(sorted(keys))
            new = rng.randrange(40)
            if new in keys:
                continue
            m = ("b",) if masks and rng.random() < 0.5 else ()
            keys.discard(k)
            keys.add(new)
            out.append(("U", (k, None, None), (new, f"m{i}", None if m else f"w{i}"), m))
        else:
            k = rng.randrange(40)
            if k not in keys:
                keys.add(k)
                out.append(("I", None, (k, f"i{i}", f"x{i}"), ()))
    return out


CASES = {
    "last write wins": [("I", None, (1, "a", "b"), ()), ("U", (1, None, None), (1, "c", "d"), ())],
    "insert then delete stays a delete": [("I", None, (7, "a", "b"), ()), ("D", (7, None, None), None, ())],
    "delete then insert": [("D", (1, None, None), None, ()), ("I", None, (1, "n", "n"), ())],
    "key change": [("U", (1, None, None), (9, "z", "z"), ())],
    "masked cell": [("U", (1, None, None), (1, "new", None), ("b",))],
    "masked after a write": [("U", (1, None, None), (1, "x", "y"), ()), ("U", (1, None, None), (1, "z", None), ("b",))],
    "null is not masked": [("U", (1, None, None), (1, "x", None), ())],
    "key change with a masked cell": [("U", (1, None, None), (9, "x", None), ("b",))],
    "move, then the old key again": [("U", (1, None, None), (9, "x", None), ("b",)), ("I", None, (1, "p", "q"), ())],
    "insert, then move": [("I", None, (5, "i", "held"), ()), ("U", (5, None, None), (6, "x", None), ("b",))],
    "chain of moves": [("U", (1, None, None), (8, "x", None), ("b",)), ("U", (8, None, None), (9, "y", None), ("b",)), ("U", (9, None, None), (9, "z", None), ("b",))],
    "truncate": [("I", None, (5, "i", "h"), ()), ("T", None, None, ()), ("I", None, (6, "j", "k"), ())],
    "nothing": [],
}
BASE = [(1, "a1", "b1"), (2, "a2", None)]


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    t, e = table(spark, BASE), events(spark, CASES[name])
    c = cdc.collapse(e, PK)
    want = replay(BASE, CASES[name])
    assert rows(cdc.apply_delete_insert(t, c)) == want
    assert rows(cdc.apply_merge(t, c)) == want


def test_insert_then_delete_still_emits_the_delete(spark):
    c = cdc.collapse(events(spark, CASES["insert then delete stays a delete"]), PK)
    assert [(r.key.k, r.op) for r in c.states.collect()] == [(7, "D")]


@pytest.mark.parametrize("seed", range(3))
def test_random_windows(spark, seed):
    rng = random.Random(seed)
    data = [(k, f"a{k}", f"b{k}") for k in rng.sample(range(40), 15)]
    w1 = random_window(rng, [r[0] for r in data], 40)
    mid = replay(data, w1)
    w2 = random_window(rng, [r[0] for r in mid], 40)
    want = replay(mid, w2)
    t = table(spark, data)
    whole = cdc.collapse(events(spark, w1 + w2), PK)
    assert rows(cdc.apply_merge(t, whole)) == want
    assert rows(cdc.apply_delete_insert(t, whole)) == want
    first = cdc.apply_merge(t, cdc.collapse(events(spark, w1), PK))
    first = spark.createDataFrame(first.collect(), ROW)
    second = cdc.collapse(events(spark, w2), PK)
    once = cdc.apply_merge(first, second)
    assert rows(once) == want


def test_whole_rows_need_one_aggregate(spark):
    rng = random.Random(11)
    items = random_window(rng, [1, 2], 60, masks=False)
    c = cdc.collapse(events(spark, items), PK, masks=False)
    assert rows(cdc.apply_merge(table(spark, BASE), c)) == rows(cdc.apply_delete_insert(table(spark, BASE), c)) == replay(BASE, items)
    log = changelog.baseline(table(spark, BASE), 0).unionByName(changelog.capture(events(spark, items), PK, masks=False))
    assert rows(changelog.current_view(log, PK)) == replay(BASE, items)
    for bad in (lambda e: cdc.collapse(e, PK, masks=False).states, lambda e: changelog.capture(e, PK, masks=False)):
        with pytest.raises(Exception, match="masked cell"):
            bad(events(spark, CASES["masked cell"])).collect()


def test_reapplying_changes_nothing(spark):
    items = random_window(random.Random(5), [1, 2], 30, masks=False, moves=False)
    c = cdc.collapse(events(spark, items), PK)
    once = spark.createDataFrame(cdc.apply_merge(table(spark, BASE), c).collect(), ROW)
    assert rows(cdc.apply_merge(once, c)) == rows(once)


@pytest.mark.parametrize("seed", range(2))
def test_current_of_changelog_is_the_replica(spark, seed):
    rng = random.Random(100 + seed)
    items = random_window(rng, [1, 2], 50)
    e = events(spark, items)
    t = table(spark, BASE)
    log = changelog.baseline(t, 0).unionByName(changelog.capture(e, PK, current=t))
    log = spark.createDataFrame(log.collect(), log.schema)
    assert rows(changelog.current_view(log, PK)) == replay(BASE, items)
    assert rows(changelog.current_view(log.unionByName(log), PK)) == replay(BASE, items)


def test_torn_and_bad_events_raise(spark):
    torn = events(spark, [("U", (3, None, None), (3, "x", None), ("b",))])
    with pytest.raises(Exception, match="torn"):
        changelog.capture(torn, PK).collect()
    with pytest.raises(Exception, match="gone"):
        cdc.apply_merge(table(spark, BASE), cdc.collapse(torn, PK)).collect()
    with pytest.raises(Exception, match="key column"):
        cdc.collapse(events(spark, [("I", None, (None, "x", "y"), ())]), PK).states.collect()
    with pytest.raises(Exception, match="unknown change op"):
        cdc.collapse(events(spark, [("X", None, (1, "x", "y"), ())]), PK).states.collect()


def test_truncate_in_a_changelog_wipes_nothing(spark):
    log = changelog.capture(events(spark, CASES["truncate"]), PK)
    assert [r._op for r in log.orderBy("_lsn").collect()] == ["I", "T", "I"]


def test_aborts_and_stop_line(spark):
    e = events(spark, [("I", None, (i, "x", "y"), ()) for i in range(6)])
    aborts = spark.createDataFrame([(2, None), (4, 0), (3, 5)], "xid bigint, sub_xid bigint")
    assert sorted(r.commit_lsn for r in cdc.committed(e, 5, aborts).collect()) == [1, 2, 4]


def test_guards():
    with pytest.raises(InvalidInput):
        cdc.check_table(ROW, [])
    with pytest.raises(InvalidInput):
        cdc.check_table(ROW, ["k"], identity=["a"])
    with pytest.raises(InvalidInput):
        changelog.check_names(["id", "_LSN"])
    with pytest.raises(InvalidInput):
        changelog.is_changelog(["_op", "x"])
    with pytest.raises(InvalidInput):
        changelog.check_shape(["k"], True)
    changelog.check_shape(["_op", "_lsn", "_seq", "_at", "k"], True)
