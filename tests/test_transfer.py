import json
import os

import pytest
from pyspark.sql import functions as F

from lodeworks.errors import InvalidInput, MultiTransferError
from lodeworks.sinks.lake import Lake
from lodeworks.transfer import read, transfer
from tests.conftest import rows


def frame(spark, lo, hi, tag="a"):
    return spark.range(lo, hi).select("id", F.concat(F.lit(tag), F.col("id")).alias("v"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,cast(id as int))").alias("ts"))


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"))


def test_replace_append_merge(spark, lake):
    go = lambda df, **k: transfer(spark, {"t": df}, lake.url, table="t", pk=("id",), **k)
    r = go(frame(spark, 0, 10), mode="append", cursor="id")
    assert r.rows == 10 and r.tables[0].watermark == "9"
    r = go(frame(spark, 0, 15), mode="append", cursor="id")
    assert r.rows == 5 and lake.table("t").frame().count() == 15
    assert go(frame(spark, 0, 15), mode="append", cursor="id").rows == 0
    r = go(frame(spark, 10, 18, "new"), mode="merge", cursor="id")
    got = rows(lake.table("t").frame().select("id", "v"))
    assert r.rows == 4 and got == sorted([(i, f"a{i}") for i in range(14)] + [(i, f"new{i}") for i in range(14, 18)], key=repr)
    lake.table("t").compact()
    assert rows(lake.table("t").frame().select("id", "v")) == got and lake.table("t").version().pk == ["id"]
    assert lake.table("t").vacuum() == 0 and lake.table("t").vacuum(older_than=0) > 0 and lake.table("t").frame().count() == 18
    go(frame(spark, 0, 3), mode="replace")
    assert lake.table("t").frame().count() == 3
    assert list(lake.table("t").version().state) == ["frames://frames://::t"] or len(lake.table("t").version().state) == 1


def test_merge_twice_and_delete(spark, lake):
    t = lake.table("m")
    t.replace(frame(spark, 0, 5), "s", "id", ["id"])
    for tag in "xy":
        t.merge(frame(spark, 2, 7, tag), "s", "id")
    t.merge(frame(spark, 0, 0), "s", "id", deletes=spark.createDataFrame([(0,), (6,)], "id long"))
    assert rows(t.frame().select("id", "v")) == [(1, "a1"), (2, "y2"), (3, "y3"), (4, "y4"), (5, "y5")]
    assert t.version().state["s"]["watermark"] == "6"


def test_empty_source_changes_nothing(spark, lake):
    go = lambda df, **k: transfer(spark, {"t": df}, lake.url, table="t", pk=("id",), **k)
    go(frame(spark, 0, 4), cursor="id")
    before = lake.table("t").version()
    for mode in ("replace", "append", "merge"):
        assert go(frame(spark, 0, 0), mode=mode, cursor="id").rows == 0
        assert lake.table("t").version() == before
    assert transfer(spark, {"none": frame(spark, 0, 0)}, lake.url, table="none").rows == 0
    assert lake.table("none").version() is None


def test_drift_and_fan_in(spark, lake):
    t = lake.table("t")
    t.replace(frame(spark, 0, 4), "other", "id", ["id"])
    with pytest.raises(InvalidInput, match="other sources"):
        transfer(spark, {"t": frame(spark, 0, 9)}, lake.url, table="t", mode="append", cursor="id")
    t.replace(frame(spark, 0, 4), "frames://frames://::t", "id", ["id"])
    odd = frame(spark, 0, 9).withColumnRenamed("v", "w")
    with pytest.raises(InvalidInput, match="drift|other sources"):
        transfer(spark, {"t": odd}, lake.url, table="t", mode="append", cursor="id")


def test_lost_commits_are_tried_again(spark, lake):
    t = lake.table("t")
    t.replace(frame(spark, 0, 3), "s", "id", ["id"])
    raced = []

    def change(v):
        if not raced:
            raced.append(1)
            lake.table("t").append(frame(spark, 3, 5), "s", "id")
        v.extra["mine"] = "yes"
        return v

    assert t.publish(change).number == 3
    assert t.frame().count() == 5 and t.version().extra["mine"] == "yes"


def test_failed_write_leaves_the_old_version(spark, lake):
    t = lake.table("t")
    t.replace(frame(spark, 0, 3), "s", "id", ["id"])
    bad = frame(spark, 0, 9).withColumn("v", F.when(F.col("id") == 5, F.raise_error(F.lit("boom")).cast("string")).otherwise("x"))
    with pytest.raises(Exception, match="boom"):
        t.replace(bad, "s", "id", ["id"])
    assert rows(t.frame().select("v")) == [("a0",), ("a1",), ("a2",)]


def test_many_tables_fail_apart(spark, lake):
    bad = frame(spark, 0, 9).withColumn("v", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(MultiTransferError) as e:
        transfer(spark, {"good": frame(spark, 0, 3), "bad": bad}, lake.url, tables={"good": "replace", "bad": "append", "gone": "replace"}, cursor=None)
    by = {t.table: t for t in e.value.report.tables}
    assert by["good"].rows == 3 and by["good"].error is None and by["bad"].error and "gone" in by["gone"].error
    assert lake.table("good").frame().count() == 3
    assert e.value.report.frame(spark).where("error is null").count() == 1


def test_guards(spark, lake, tmp_path):
    f = {"t": frame(spark, 0, 3)}
    for bad in (dict(table="t", tables=["t"]), dict(table="t", mode="nope"), dict(tables=["t"], dest_table="x"), dict(table="t", mode="merge", cursor="id"), dict(table="t", mode="append", cursor="v"), dict(table="t", mode="log_based"), dict(table="t", engine="MergeTree")):
        with pytest.raises(InvalidInput):
            transfer(spark, f, lake.url, **bad)
    for mode in ("append", "merge"):
        with pytest.raises(InvalidInput, match="only"):
            transfer(spark, f, f"parquet://{tmp_path}/o", table="t", mode=mode, cursor="id", pk=("id",))
    with pytest.raises(InvalidInput):
        transfer(spark, "ftp://u:pw@h/x", lake.url, table="t")
    with pytest.raises(InvalidInput):
        read(spark, f, "t", columns=["nope"])


def test_objects(spark, tmp_path):
    df = frame(spark, 0, 5).withColumn("n", F.when(F.col("id") > 2, "").when(F.col("id") > 1, "a,b")).withColumn("l", F.array("id"))
    assert transfer(spark, {"t": df}, f"csv://{tmp_path}/c", table="t").rows == 5
    back = spark.read.csv(f"{tmp_path}/c/t.csv.gz", header=True, inferSchema=False)
    assert back.count() == 5 and os.path.isfile(f"{tmp_path}/c/t.csv.gz")
    transfer(spark, {"t": df}, f"parquet://{tmp_path}/p", table="t", partition_by=None, order_by="v")
    got = spark.read.parquet(f"{tmp_path}/p/t.parquet")
    assert got.count() == 5 and dict(got.dtypes)["l"] == "string"
    assert [r.n for r in got.orderBy("id").collect()] == [None, None, "a,b", "", ""]


def test_reader(spark, tmp_path):
    r = read(spark, {"t": frame(spark, 0, 100)}, "t", columns=["v", "id"])
    assert r.columns == ["v", "id"] and r.schema[1][:2] == ("id", "bigint")
    assert r.to_arrow().num_rows == len(r.to_pandas()) == 100
    assert [b.num_rows for b in r.batches(64)] == [64, 36]
    assert r.to_parquet(str(tmp_path / "x")) == 100
    plan = read(spark, f"parquet://{tmp_path}", "nothere") if False else None
    assert plan is None
    import pyarrow as pa

    assert pa.table(r).num_rows == 100


def test_partitioned_replace(spark, lake):
    transfer(spark, {"t": frame(spark, 0, 5)}, lake.url, table="t", partition_by="ts")
    v = lake.table("t").version()
    assert any(n.startswith("_month=") for n in os.listdir(f"{lake.table('t').path}/data/{v.data[0][0]}"))
    assert lake.table("t").frame().columns == ["id", "v", "ts"]


def test_csv_repository(spark, lake, tmp_path):
    root = tmp_path / "repo"
    (root / "sub").mkdir(parents=True)
    (root / "edge.csv").write_text('id,,note\n1,"a,b","two\nlines"\n2,"say ""hi""",\n3\n\n4,é,"x\r\ny"\n', newline="")
    (root / "sub" / "dup.csv").write_text("a,b\n1,2\n")
    (root / "dup.csv").write_text("a,b\n1,2\n3,4\n")
    (root / "long.csv").write_text("a,b\n1,2,3\n")
    (root / "twice.csv").write_text("a,A\n1,2\n")
    src = f"csv://{root}"
    got = read(spark, src, "edge").lazy()
    assert got.columns == ["id", "col_2", "note"]
    assert rows(got) == sorted([("1", "a,b", "two\nlines"), ("2", 'say "hi"', None), ("3", None, None), ("4", "é", "x\r\ny")], key=repr)
    assert read(spark, src, "dup").lazy().count() == 2 and read(spark, src, "sub/dup").lazy().count() == 1
    with pytest.raises(Exception, match="longer than the header"):
        read(spark, src, "long").lazy().collect()
    for bad in ("twice", "edge.csv", "nope", "../x"):
        with pytest.raises(InvalidInput):
            read(spark, src, bad)
    assert transfer(spark, src, lake.url, table="edge").rows == 4


def test_sheet_pages(spark, tmp_path):
    d = tmp_path / "book" / "tab one"
    d.mkdir(parents=True)
    (d / "0.json").write_text(json.dumps({"values": [["id", ""], ["1", "x"], ["2"]]}))
    (d / "1.json").write_text(json.dumps({"values": [["3", ""]]}))
    got = read(spark, f"sheets://{tmp_path}/book", "tab one").lazy()
    assert rows(got.select("id", "col_2")) == [("1", "x"), ("2", None), ("3", None)]


def test_api_pages(spark, tmp_path):
    def page(entity, *objs, wrap=None):
        d = tmp_path / "api" / entity
        d.mkdir(parents=True, exist_ok=True)
        (d / f"{len(os.listdir(d))}.json").write_text(json.dumps({wrap: list(objs)} if wrap else list(objs)))

    page("issues", {"id": 1, "number": 7, "title": "t\u0000x", "user": {"login": "me"}, "labels": [{"name": "bug"}], "created_at": "2024-05-01T10:00:00Z"}, {"id": 2, "pull_request": {"url": "u"}})
    page("issues", {"id": 3, "user": None})
    page("workflow_runs", {"id": 9, "head_sha": "abc"}, wrap="workflow_runs")
    page("issue_comments", {"id": 4, "issue_url": "https://h/repos/o/r/issues/123"})
    page("labels", {"id": 5, "name": "bug", "default": True})
    src = f"api://{tmp_path}/api"
    got = {r.id: r for r in read(spark, src, "issues").lazy().collect()}
    assert sorted(got) == [1, 3] and got[1].author == "me" and got[1].title == "tx" and json.loads(got[1].labels)[0]["name"] == "bug"
    assert str(got[1].created_at) == "2024-05-01 10:00:00" and got[3].author is None and json.loads(got[3].raw)["id"] == 3
    assert read(spark, src, "workflow_runs").lazy().first().sha == "abc"
    assert read(spark, src, "issue_comments").lazy().first().issue_number == 123
    assert read(spark, src, "labels").lazy().first().is_default is True
    with pytest.raises(InvalidInput):
        read(spark, src, "wikis")


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = frame(spark, 0, 50).withColumn("ts", F.col("ts").cast("timestamp"))
    assert transfer(spark, {"T": df}, url, table="T", cursor="id", pk=("id",)).rows == 50
    plan = read(spark, url, "T", cursor="id", parallel=2).lazy()
    assert plan.rdd.getNumPartitions() > 1 and plan.count() == 50
    one = plan.where("id > 40").select("id")
    assert one.count() == 9 and "PushedFilters: [" in one._jdf.queryExecution().explainString(one._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    more = frame(spark, 0, 60, "b").withColumn("ts", F.col("ts").cast("timestamp"))
    assert transfer(spark, {"T": more}, url, table="T", cursor="id", mode="append").rows == 10
    assert transfer(spark, {"T": more}, url, table="T", cursor="id", mode="merge", pk=("id",)).rows == 1
    assert transfer(spark, {"T": more.limit(0)}, url, table="T", cursor="id").rows == 0
    assert read(spark, url, query='select count(*) as n from "T"').lazy().first()[0] == 60
    assert transfer(spark, {"T": df}, url, table="T", cursor="id").rows == 50
    assert read(spark, url, "T").lazy().count() == 50
