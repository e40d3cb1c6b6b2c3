import json

import pytest

from lodeworks.errors import InvalidInput, MultiTransferError
from lodeworks.operators import cdc
from lodeworks.sinks.jdbc import JdbcSink
from lodeworks.sinks.lake import Lake
from lodeworks.streaming import drain
from lodeworks.transfer import transfer
from tests.conftest import rows
from tests.test_cdc import BASE, PK, ROW


def start(spark, root, **more):
    root.mkdir()
    (root / "server.json").write_text(json.dumps({"server": "s", "snapshot_lsn": 100, "tables": {"a": {"pk": PK}}, **more}))
    spark.createDataFrame(BASE, ROW).write.parquet(f"{root}/a/snapshot")
    (root / "a" / "log").mkdir()


def write(spark, root, lsn, keys, seq=0, xid=0):
    data = [(lsn, xid, 0, seq + i, "I", None, (k, f"v{k}", None), []) for i, k in enumerate(keys)]
    spark.createDataFrame(data, cdc.event_schema(ROW)).coalesce(1).write.mode("append").parquet(f"{root}/a/log")


def follow(spark, root, files=2, **more):
    lake = Lake(spark, f"{root}/lake")
    return lake.table("a"), drain.follow(drain.ChangeLog(spark, str(root)), lake, ["a"], f"{root}/ck", files=files, **more)[0]


def test_a_commit_over_many_files_is_whole_and_late_events_are_refused(spark, tmp_path):
    root = tmp_path / "log"
    start(spark, root)
    for i in range(6):
        write(spark, root, 110, [50 + i], seq=i)
    table, report = follow(spark, root)
    assert report.error is None and report.rows == 6 + len(BASE) and table.frame().count() == 6 + len(BASE)
    assert table.version().extra["held"] == "[]" and list(table.version().state.values())[0]["watermark"] == "110"
    write(spark, root, 105, [99])
    _, report = follow(spark, root)
    assert "behind the watermark" in report.error and table.frame().where("k = 99").count() == 0


def test_stop_line_aborts_and_a_stop_before_the_start(spark, tmp_path):
    root = tmp_path / "log"
    start(spark, root, stop_lsn=120)
    spark.createDataFrame([(7, None)], "xid bigint, sub_xid bigint").write.parquet(f"{root}/a/aborts")
    write(spark, root, 110, [50])
    write(spark, root, 111, [51], xid=7)
    write(spark, root, 130, [52])
    drain.request_stop()
    table, report = follow(spark, root)
    assert report.error is None and table.frame().count() == len(BASE)
    table, _ = follow(spark, root)
    assert {r.k for r in table.frame().collect()} == {r[0] for r in BASE} | {50}
    assert follow(spark, root, seconds=0.0)[1].error is None


def test_guards_stand_before_the_drain(spark, tmp_path):
    for i, (more, text) in enumerate([({"settings": {"wal_level": "replica"}}, "can't be followed"), ({"oldest_lsn": 500}, "changes are lost")]):
        root = tmp_path / f"log{i}"
        start(spark, root)
        follow(spark, root)
        meta = json.loads((root / "server.json").read_text())
        (root / "server.json").write_text(json.dumps({**meta, **more}))
        assert text in follow(spark, root)[1].error
    root = tmp_path / "note"
    start(spark, root)
    write(spark, root, 110, [50])
    follow(spark, root)
    assert "retains" in follow(spark, root, warn_above=1)[1].note


def test_composite_keys_fold_as_one_by_one(spark):
    schema = "struct<a:string,b:string,v:int>"
    data = [(1, 0, 0, 0, "U", ("1", "23", 1), ("12", "3", 2), []), (2, 0, 0, 0, "U", ("12", "3", 2), ("12", "3", 3), []), (3, 0, 0, 0, "U", ("x", "", 1), ("", "x", 5), ["v"])]
    events = spark.createDataFrame(data, f"commit_lsn bigint, xid bigint, sub_xid bigint, seq bigint, op string, before {schema}, after {schema}, masked array<string>")
    target = spark.createDataFrame([("1", "23", 1), ("x", "", 9), ("keep", "me", 0)], "a string, b string, v int")
    for apply in (cdc.apply_merge, cdc.apply_delete_insert):
        assert rows(apply(target, cdc.collapse(events, ["a", "b"]))) == sorted([("12", "3", 3), ("", "x", 9), ("keep", "me", 0)], key=repr)


def test_a_retried_commit_checks_the_schema_again(spark, tmp_path):
    table = Lake(spark, str(tmp_path)).table("t")
    table.replace(spark.createDataFrame(BASE, ROW), "s", "k", PK)
    then = table.version()
    table.replace(spark.createDataFrame([(1, 2)], "k int, z int"), "s", "k", PK)
    with pytest.raises(Exception, match="another schema"):
        table._check_same(then, table.version())


def test_publishing_leaves_no_moment_without_a_table():
    class Sink(JdbcSink):
        def __init__(self, scheme):
            self.scheme, self.quote, self.limit = scheme, '"', 64

    mysql, click, pg = (Sink(s).publish_sql("t", "t_new", True) for s in ("mysql", "clickhouse", "postgres"))
    assert mysql[1] == 'RENAME TABLE "t" TO "t__lodeworks_old", "t_new" TO "t"' and mysql[2].startswith("DROP")
    assert click == ['EXCHANGE TABLES "t_new" AND "t"', 'DROP TABLE "t_new"']
    assert pg == ['DROP TABLE "t"', 'ALTER TABLE "t_new" RENAME TO "t"']
    assert Sink("clickhouse").publish_sql("t", "t_new", False) == ['RENAME TABLE "t_new" TO "t"']


def test_mixed_modes_report_all_tables(spark, tmp_path, capsys):
    root = tmp_path / "log"
    start(spark, root)
    spark.createDataFrame(BASE, ROW).write.parquet(f"{root}/b/snapshot")
    meta = json.loads((root / "server.json").read_text())
    (root / "server.json").write_text(json.dumps({**meta, "tables": {"a": {"pk": PK}, "b": {"pk": PK}}}))
    report = transfer(spark, f"log://{root}", f"lake://{root}/lake", tables={"a": "log_based", "b": "replace"}, progress="pairs")
    assert [(t.table, t.mode, t.error) for t in report.tables] == [("b", "replace", None), ("a", "log_based", None)]
    assert "table=b rows=" in capsys.readouterr().err
    with pytest.raises((InvalidInput, MultiTransferError)):
        transfer(spark, f"log://{root}", f"parquet://{root}/x", tables={"a": "log_based", "b": "replace"})
