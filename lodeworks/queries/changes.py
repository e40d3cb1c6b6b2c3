"""Change-data queries over a log that is derived from events: the key is
user_id, the log position event_id; a tenth are deletes, a fifth leave `props` out."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.operators import cdc, changelog
from lodeworks.queries.common import Registry, table

add = Registry()
QUERIES, SQL = add.queries, add.sql
ROW = "struct<user_id:bigint,value:double,event_type:string>"
#: The first 200 keys have a row before the window starts.
TARGET_SQL = "target as (select user_id, -1.0::double as value, 'old' as event_type from (select distinct user_id from events) where user_id % 2 = 0)"
LOG_SQL = "log as (select event_id, user_id, value, event_type, case when event_id % 10 = 7 then 'D' else 'U' end as op, event_id % 5 = 2 and event_id % 10 <> 7 as mask from events)"


def log(spark, sf_dir, masks: bool = False, truncate_at: int | None = None):
    e = table(spark, sf_dir, "events")
    row = F.struct("user_id", "value", "event_type")
    op = F.when(F.col("event_id") % 10 == 7, "D").otherwise("U")
    mask = F.when((F.col("event_id") % 5 == 2) & (F.col("event_id") % 10 != 7), F.array(F.lit("event_type"))).otherwise(F.array().cast("array<string>"))
    out = e.select(
        F.col("event_id").alias("commit_lsn"), (F.col("event_id") % 50).alias("xid"), (F.col("event_id") % 3).alias("sub_xid"), F.lit(0).cast("bigint").alias("seq"), op.alias("op"),
        F.when(op == "D", row).cast(ROW).alias("before"), F.when(op == "U", row).cast(ROW).alias("after"), (mask if masks else F.array().cast("array<string>")).alias("masked"),
    )
    if truncate_at is not None:
        t = spark.createDataFrame([(truncate_at, 0, 0, 1, "T", None, None, [])], out.schema)
        out = out.unionByName(t)
    return out


def target(spark, sf_dir, every: bool = False):
    keys = table(spark, sf_dir, "events").select("user_id").distinct()
    keys = keys if every else keys.where("user_id % 2 = 0")
    return keys.select("user_id", F.lit(-1.0).alias("value"), F.lit("old").alias("event_type"))


@add(f"with {LOG_SQL} select user_id, op, case when op = 'U' then value end as value from log qualify row_number() over (partition by user_id order by event_id desc) = 1")
def collapse_last_write(spark, sf_dir):
    c = cdc.collapse(log(spark, sf_dir), ["user_id"], masks=False)
    return c.states.select("key.user_id", "op", F.col("row.value").alias("value"))


APPLIED = f"""with {LOG_SQL}, {TARGET_SQL}, fin as (select * from log qualify row_number() over (partition by user_id order by event_id desc) = 1)
select user_id, value, event_type from fin where op = 'U' union all select * from target where user_id not in (select user_id from fin)"""


@add(APPLIED)
def delete_insert_apply(spark, sf_dir):
    return cdc.apply_delete_insert(target(spark, sf_dir), cdc.collapse(log(spark, sf_dir), ["user_id"], masks=False))


@add(APPLIED)
def merge_apply(spark, sf_dir):
    return cdc.apply_merge(target(spark, sf_dir), cdc.collapse(log(spark, sf_dir), ["user_id"], masks=False))


MASKED_SQL = f"""with {LOG_SQL}, d as (select user_id, max(event_id) as died from log where op = 'D' group by 1),
live as (select l.*, d.died from log l left join d using (user_id) where l.op = 'U' and (d.died is null or l.event_id > d.died)),
fin as (select user_id, arg_max(value, event_id) as value, arg_max(event_type, event_id) filter (where not mask) as seen from live group by 1)
select user_id, value, coalesce(seen, 'old') as event_type from fin"""


@add(MASKED_SQL)
def masked_update(spark, sf_dir):
    """Cells that the log leaves out: the window's last value, else the target's."""
    return cdc.apply_merge(target(spark, sf_dir, every=True), cdc.collapse(log(spark, sf_dir, masks=True), ["user_id"]))


@add(f"""with {LOG_SQL}, fin as (select * from log where event_id > 400 qualify row_number() over (partition by user_id order by event_id desc) = 1)
select user_id, value, event_type from fin where op = 'U'""")
def truncate_window(spark, sf_dir):
    return cdc.apply_delete_insert(target(spark, sf_dir), cdc.collapse(log(spark, sf_dir, truncate_at=400), ["user_id"], masks=False))


def _moving(spark, sf_dir):
    """Every 9th event moves its row to a new key."""
    e = table(spark, sf_dir, "events").where("event_id <= 900")
    new = F.col("user_id") + F.when(F.col("event_id") % 9 == 0, 1_000_000 + F.col("event_id")).otherwise(0)
    row = lambda k: F.struct(k.alias("user_id"), F.col("value"), F.col("event_type")).cast(ROW)
    return e.select(F.col("event_id").alias("commit_lsn"), F.lit(0).cast("bigint").alias("xid"), F.lit(0).cast("bigint").alias("sub_xid"), F.lit(0).cast("bigint").alias("seq"), F.lit("U").alias("op"), row(F.col("user_id")).alias("before"), row(new).alias("after"), F.array().cast("array<string>").alias("masked"))


@add("""with e as (select event_id, user_id, value, event_type, event_id % 9 = 0 as moved from events where event_id <= 900)
select 'D' as _op, event_id as _lsn, 1::bigint as _seq, user_id, value, event_type from e where moved
union all select 'U', event_id, case when moved then 2 else 1 end::bigint, user_id + case when moved then 1000000 + event_id else 0 end, value, event_type from e""")
def changelog_capture(spark, sf_dir):
    return changelog.capture(_moving(spark, sf_dir), ["user_id"], masks=False).drop("_at")


@add("""with e as (select event_id, user_id, value, event_type, event_id % 9 = 0 as moved from events where event_id <= 900),
x as (select 'D' as op, event_id, user_id, value, event_type from e where moved
 union all select 'U', event_id, user_id + case when moved then 1000000 + event_id else 0 end, value, event_type from e),
f as (select * from x qualify row_number() over (partition by user_id order by event_id desc) = 1)
select user_id, value, event_type from f where op = 'U'""")
def key_change_apply(spark, sf_dir):
    """An update that changes the key deletes the old row."""
    empty = spark.createDataFrame([], "user_id bigint, value double, event_type string")
    return cdc.apply_merge(empty, cdc.collapse(_moving(spark, sf_dir), ["user_id"], masks=False))


@add(f"""with {LOG_SQL}, x as (select *, row_number() over (partition by user_id order by event_id desc) as n from log where event_id > 300)
select user_id, value, event_type from x where n = 1 and op = 'U'""")
def changelog_current(spark, sf_dir):
    """The current view over a captured log with a truncate in it, landed twice."""
    rows = changelog.capture(log(spark, sf_dir, truncate_at=300), ["user_id"], masks=False)
    return changelog.current_view(rows.unionByName(rows), ["user_id"])


@add(f"""with {LOG_SQL}, w as (select event_id, user_id, value, op, mask, event_type, max(case when op = 'U' and not mask then event_id end) over (partition by user_id order by event_id) as src from log)
select w.op as _op, w.event_id as _lsn, w.user_id, w.value, case when not w.mask then w.event_type else coalesce(s.event_type, 'old') end as event_type
from w left join events s on s.event_id = w.src""")
def changelog_masks(spark, sf_dir):
    """Left-out cells in a changelog: last told in the window, else the current view's."""
    rows = changelog.capture(log(spark, sf_dir, masks=True), ["user_id"], current=target(spark, sf_dir, every=True))
    return rows.select("_op", "_lsn", "user_id", "value", "event_type")


@add("""select event_id as commit_lsn from events where event_id <= 800 and event_id % 50 <> 4 and not (event_id % 50 = 9 and event_id % 3 = 1)""")
def tx_abort_filter(spark, sf_dir):
    """A stop line, one aborted transaction, and one rolled back to a savepoint."""
    aborts = spark.createDataFrame([(4, None), (9, 1)], "xid bigint, sub_xid bigint")
    return cdc.committed(log(spark, sf_dir), 800, aborts).select("commit_lsn")


@add("select 'B' as _op, 77::bigint as _lsn, 0::bigint as _seq, c_custkey, c_name from customer")
def changelog_baseline(spark, sf_dir):
    return changelog.baseline(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 77).drop("_at")
