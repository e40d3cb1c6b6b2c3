"""Landing modes and watermarks, as frames."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lodeworks.operators.incremental import append_delta, first_per_key, latest_per_key, merge_upsert, without_keys
from lodeworks.plans import types, watermark
from lodeworks.plans.spec import RunReport, TableReport
from lodeworks.queries.common import Registry, table

add = Registry()
QUERIES, SQL = add.queries, add.sql
HALF = "(select max(event_id) // 2 from events)"


def _half(e) -> int:
    return e.agg(F.max("event_id")).first()[0] // 2


@add("select strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as ts_mark, max(event_id)::varchar as id_mark from events")
def watermark_max(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.agg(watermark.rendered(F.col("ts"), e.schema["ts"].dataType).alias("ts_mark"), watermark.rendered(F.col("event_id"), LongType()).alias("id_mark"))


@add(f"select * from events where event_id > {HALF}")
def append_delta_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return append_delta(e, "event_id", str(_half(e)))


@add(f"""with target as (select user_id, event_id, value from events where event_id <= {HALF} qualify row_number() over (partition by user_id order by event_id desc) = 1),
delta as (select user_id, event_id, value from events where event_id >= {HALF} qualify row_number() over (partition by user_id order by event_id desc) = 1)
select * from delta union all select * from target where user_id not in (select user_id from delta)""")
def merge_upsert_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    half = _half(e)
    target = latest_per_key(e.where(F.col("event_id") <= half), ["user_id"], ["event_id"])
    return merge_upsert(target, e.where(F.col("event_id") >= half), ["user_id"], "event_id")


@add("select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def newest_per_key(spark, sf_dir):
    return latest_per_key(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "ts", "user_id", "event_type", "value", "props")


@add("select event_type, user_id, event_id, value from events qualify row_number() over (partition by event_type order by value desc, event_id) = 1")
def first_per_key_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "value")
    return first_per_key(e, ["event_type"], [F.desc("value"), F.col("event_id")])


@add("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def delete_by_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return without_keys(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), keys, ["c_custkey"])


@add("""select r_regionkey::bigint as r_regionkey, r_name from region""")
def lake_schema(spark, sf_dir):
    """What a lake holds of a table: whole numbers as long."""
    return types.to_sink_schema(table(spark, sf_dir, "region"), "parquet")


@add("""select l_linenumber::smallint as i2, l_linenumber::bigint as i8, l_quantity::decimal(18,4)::varchar as dec, l_orderkey::decimal(20,0)::varchar as u64, l_discount::float::double as f4
from lineitem where l_orderkey < 500""")
def type_widening(spark, sf_dir):
    """Casts by the mapped native types."""
    c = lambda col, kind, name, show=None: F.col(col).cast(kind).cast(show or kind).alias(name)
    rows = table(spark, sf_dir, "lineitem").where("l_orderkey < 500")
    return rows.select(c("l_linenumber", types.from_clickhouse("Nullable(UInt8)"), "i2"), c("l_linenumber", types.from_postgres("int8"), "i8"), c("l_quantity", types.from_postgres("numeric(18,4)"), "dec", "string"), c("l_orderkey", types.from_mysql("bigint(20) unsigned"), "u64", "string"), c("l_discount", types.from_mysql("float"), "f4", "double"))


@add("select sum(n)::bigint as rows, count(*) as tables from (select count(*) as n from orders union all select count(*) from events)")
def report_totals(spark, sf_dir):
    """Only tables without an error count."""
    report = RunReport([TableReport(t, rows=table(spark, sf_dir, t).count()) for t in ("orders", "events")] + [TableReport("gone", rows=5, error="no such table")])
    return report.frame(spark).where("error is null").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("tables"))


@add("""select * from (values (1, '9'), (2, '9'), (3, '5'), (4, null)) t(id, mark)""")
def watermark_resolution(spark, sf_dir):
    """The truth table: later wins, junk loses, state alone where it is trusted, none at all."""
    t = watermark.Trust
    rows = [(1, watermark.resolve("5", "9", False, t.LATER)), (2, watermark.resolve("junk", "9", False, t.LATER)), (3, watermark.resolve("5", "9", False, t.STATE)), (4, watermark.resolve(None, None, False, t.LATER))]
    return spark.createDataFrame(rows, "id int, mark string")
