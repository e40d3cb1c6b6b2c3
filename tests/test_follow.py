import json

import pytest

from lodeworks.errors import InvalidInput, MultiTransferError
from lodeworks.operators import cdc, changelog
from lodeworks.sinks.lake import Lake
from lodeworks.streaming.drain import ChangeLog, apply_window, cut_groups, group_start
from lodeworks.transfer import transfer
from tests.conftest import rows
from tests.test_cdc import BASE, PK, ROW, replay

ITEMS = [
    [("U", (1, None, None), (1, "x", None), ("b",)), ("I", None, (3, "n", "n"), ())],
    [("D", (2, None, None), None, ()), ("U", (1, None, None), (9, "moved", None), ("b",))],
    [("U", (9, None, None), (9, "last", None), ("b",)), ("I", None, (4, "p", "q"), ())],
]


def make_log(spark, root, tables, server="s1"):
    root.mkdir(exist_ok=True)
    (root / "server.json").write_text(json.dumps({"server": server, "snapshot_lsn": 100, "tables": {t: {"pk": PK} for t in tables}}))
    for t in tables:
        spark.createDataFrame(BASE, ROW).write.mode("overwrite").parquet(f"{root}/{t}/snapshot")
        (root / t / "log").mkdir(exist_ok=True)


def write_window(spark, root, t, i):
    lsn = 101 + 10 * i
    data = [(lsn + j, 0, 0, 0, op, b, a, list(m)) for j, (op, b, a, m) in enumerate(ITEMS[i])]
    spark.createDataFrame(data, cdc.event_schema(ROW)).coalesce(1).write.mode("append").parquet(f"{root}/{t}/log")


@pytest.mark.parametrize("as_log", [False, True])
def test_follow(spark, tmp_path, as_log):
    root, lake = tmp_path / "log", Lake(spark, str(tmp_path / "lake"))
    make_log(spark, root, ["a", "b"])
    go = lambda: transfer(spark, f"log://{root}", lake.url, tables=["a", "b"], mode="log_based", slots=2, changelog=as_log)
    state = lambda t: rows(changelog.current_view(lake.table(t).frame(), PK) if as_log else lake.table(t).frame())
    assert go().rows == 4 and state("a") == replay(BASE, [])
    done = []
    for i in range(3):
        write_window(spark, root, "a", i)
        done += ITEMS[i]
        go()
        assert state("a") == replay(BASE, done)
        assert state("b") == replay(BASE, [])
    version = lake.table("a").version()
    assert list(version.state.values())[0]["watermark"] == "122"
    go()
    assert lake.table("a").version() == version
    with pytest.raises(MultiTransferError):
        transfer(spark, f"log://{root}", lake.url, tables=["a", "b"], mode="log_based", changelog=not as_log)


def test_replayed_window_is_skipped(spark, tmp_path):
    root, lake = tmp_path / "log", Lake(spark, str(tmp_path / "lake"))
    make_log(spark, root, ["a"])
    transfer(spark, f"log://{root}", lake.url, table="a", mode="log_based")
    write_window(spark, root, "a", 0)
    e = spark.read.schema(cdc.event_schema(ROW)).parquet(f"{root}/a/log")
    source = f"log://{ChangeLog(spark, str(root)).mark}"
    assert apply_window(lake.table("a"), e, source, PK, False, "q:0") == 2
    n = lake.table("a").version().number
    assert apply_window(lake.table("a"), e, source, PK, False, "q:0") == 0
    assert apply_window(lake.table("a"), e, source, PK, False, "other:0") == 0
    assert lake.table("a").version().number == n and rows(lake.table("a").frame()) == replay(BASE, ITEMS[0])


def test_another_server_is_refused(spark, tmp_path):
    root, lake = tmp_path / "log", Lake(spark, str(tmp_path / "lake"))
    make_log(spark, root, ["a"])
    transfer(spark, f"log://{root}", lake.url, table="a", mode="log_based")
    make_log(spark, root, ["a"], server="s2")
    with pytest.raises(InvalidInput, match="another server"):
        transfer(spark, f"log://{root}", lake.url, table="a", mode="log_based")


def test_groups():
    assert cut_groups("dbca", 2) == [["a", "b"], ["c", "d"]]
    assert cut_groups("abc", 9) == [["a"], ["b"], ["c"]]
    assert group_start({"a": None, "b": None}) is None
    assert group_start({"a": 7, "b": 5}) == 5
    with pytest.raises(InvalidInput, match="torn"):
        group_start({"a": 7, "b": None})


@pytest.mark.parametrize("as_log", [False, True])
def test_a_log_of_one_file_is_spread_over_tasks(spark, tmp_path, monkeypatch, as_log):
    root, lake, sizes = tmp_path / "log", Lake(spark, str(tmp_path / "lake")), []
    make_log(spark, root, ["a"])
    one = [(101, 0, 0, i, "I", None, (10 + i, "n", "x"), []) for i in range(3000)]
    data = one + [(102 + i, 0, 0, 0, "U", None, (10 + i, f"{i}", None), ["b"]) for i in range(1000)]
    spark.createDataFrame(data, cdc.event_schema(ROW)).coalesce(1).write.mode("append").parquet(f"{root}/a/log")
    module, name = (changelog, "capture") if as_log else (cdc, "collapse")
    real = getattr(module, name)
    monkeypatch.setattr(module, name, lambda events, *a, **k: sizes.append(events.rdd.glom().map(len).collect()) or real(events, *a, **k))
    transfer(spark, f"log://{root}", lake.url, table="a", mode="log_based", changelog=as_log)
    assert max(sum(s) for s in sizes) == 3999 and all(max(s) < 0.6 * sum(s) for s in sizes if sum(s) > 100)
    table = lake.table("a").frame()
    now = rows(changelog.current_view(table, PK) if as_log else table)
    assert len(now) == len(BASE) + 3000 and [r for r in now if r[0] == 15] == [(15, "5", "x")]
