"""Queries whose result has been through storage: landed, published, read again."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import changelog
from lodeworks.queries import changes
from lodeworks.queries.common import Registry, table
from lodeworks.session import scratch
from lodeworks.sinks.lake import Lake
from lodeworks.transfer import read, transfer

add = Registry()
QUERIES, SQL = add.queries, add.sql


def put(spark: SparkSession, path: str, text: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


@add("""with m as (select max(event_id) as top from events)
select event_id, user_id, case when event_id = top then -value else value end as value from events, m""")
def lake_append_then_merge(spark, sf_dir):
    """First run, increment by watermark, upsert from the watermark, all as published versions."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    half = e.agg(F.max("event_id")).first()[0] // 2
    dst = "lake://" + scratch(spark)
    opts = dict(table="events", cursor="event_id", pk=("event_id",))
    transfer(spark, {"events": e.where(F.col("event_id") <= half)}, dst, mode="append", **opts)
    transfer(spark, {"events": e}, dst, mode="append", **opts)
    transfer(spark, {"events": e.withColumn("value", -F.col("value"))}, dst, mode="merge", **opts)
    return read(spark, dst, "events").lazy()


@add("select r_name, r_regionkey from region where r_regionkey <> 2 union all select 'Atlantis', 9")
def lake_merge_on_read(spark, sf_dir):
    """Upserts and deletes that are only files of keys until the table is compacted."""
    lake = Lake(spark, scratch(spark))
    t = lake.table("region")
    r = table(spark, sf_dir, "region")
    t.replace(r, "s", "r_regionkey", ["r_regionkey"])
    more = spark.createDataFrame([(9, "Nowhere")], r.schema)
    t.merge(more, "s", "r_regionkey")
    t.merge(spark.createDataFrame([(9, "Atlantis")], r.schema), "s", "r_regionkey", deletes=r.where("r_regionkey = 2"))
    return t.frame().select("r_name", "r_regionkey")


@add("select count(*) as n, 0 as changed from customer")
def zero_row_guard(spark, sf_dir):
    """An empty source leaves the destination, in every mode."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    dst = "lake://" + scratch(spark)
    opts = dict(table="customer", cursor="c_custkey", pk=("c_custkey",))
    transfer(spark, {"customer": c}, dst, **opts)
    moved = sum(transfer(spark, {"customer": c.limit(0)}, dst, mode=m, **opts).rows for m in ("replace", "append", "merge"))
    return read(spark, dst, "customer").lazy().agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(moved).alias("changed"))


@add("select n_nationkey::varchar as n_nationkey, n_name, case when n_regionkey = 0 then null else 'r ' || n_regionkey || ', \"q\"' end as note from nation")
def csv_repository(spark, sf_dir):
    """A CSV file with quotes, commas and empty fields, by its stem."""
    root = scratch(spark)
    lines = ["n_nationkey,n_name,note"]
    for r in table(spark, sf_dir, "nation").collect():
        note = "" if r.n_regionkey == 0 else f'"r {r.n_regionkey}, ""q"""'
        lines.append(f"{r.n_nationkey},{r.n_name},{note}")
    put(spark, f"{root}/data/nation.csv", "\n".join(lines) + "\n")
    return read(spark, f"csv://{root}", "nation").lazy()


@add("select s_suppkey::varchar as s_suppkey, s_name from supplier")
def object_csv(spark, sf_dir):
    """One gzip CSV object, read back."""
    root = scratch(spark)
    transfer(spark, {"supplier": table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")}, f"csv://{root}", table="supplier")
    return spark.read.csv(f"{root}/supplier.csv.gz", header=True, schema="s_suppkey string, s_name string")


def _log(spark, sf_dir, masks: bool) -> str:
    root = scratch(spark)
    put(spark, f"{root}/server.json", json.dumps({"server": "test", "snapshot_lsn": 0, "tables": {"users": {"pk": ["user_id"]}}}))
    changes.target(spark, sf_dir, every=masks).write.parquet(f"{root}/users/snapshot")
    e = changes.log(spark, sf_dir, masks=masks).withColumn("commit_lsn", F.col("commit_lsn") + 1)
    for part, files in enumerate((1, 15)):  # so many make one window of a drain
        e.where((F.col("commit_lsn") > 500) == bool(part)).repartitionByRange(files, "commit_lsn").write.mode("append").parquet(f"{root}/users/log")
    return root


@add(changes.MASKED_SQL)
def follow_replica(spark, sf_dir):
    """Snapshot, then the log by Structured Streaming, into a table that is the source's state."""
    root = _log(spark, sf_dir, masks=True)
    transfer(spark, f"log://{root}", f"lake://{root}/lake", table="users", mode="log_based")
    return read(spark, f"lake://{root}/lake", "users").lazy()


@add(f"""with {changes.LOG_SQL}, w as (select *, max(case when op = 'U' and not mask then event_id end) over (partition by user_id order by event_id) as src from log),
f as (select * from w qualify row_number() over (partition by user_id order by event_id desc) = 1)
select f.user_id, f.value, case when not f.mask then f.event_type else coalesce(s.event_type, 'old') end as event_type
from f left join events s on s.event_id = f.src where f.op = 'U'""")
def follow_changelog(spark, sf_dir):
    """The same as an append-only log, and its current view."""
    root = _log(spark, sf_dir, masks=True)
    transfer(spark, f"log://{root}", f"lake://{root}/lake", table="users", mode="log_based", changelog=True)
    return changelog.current_view(read(spark, f"lake://{root}/lake", "users").lazy(), ["user_id"])
