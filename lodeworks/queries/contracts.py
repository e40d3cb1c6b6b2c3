"""Queries for what the rest leaves out: validation, names, API entities, readers, sinks, keys of several columns."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, LongType, StringType, StructField, StructType

from lodeworks import naming
from lodeworks.errors import InvalidInput, TransferError
from lodeworks.functions import scalar as S
from lodeworks.operators import cdc, changelog
from lodeworks.operators.incremental import check_drift, without_keys
from lodeworks.plans import spec, watermark
from lodeworks.queries import changes
from lodeworks.queries.common import Registry, table
from lodeworks.queries.stored import put, scratch
from lodeworks.sinks.lake import Lake
from lodeworks.sources import identity
from lodeworks.sources.repo_api import ENTITIES, entity_frame
from lodeworks.streaming import drain, guards
from lodeworks.transfer import read, transfer

add = Registry()
QUERIES, SQL = add.queries, add.sql

# keys of two columns, whose texts run together to the same one before and after a move
PAIR = "struct<a:string,b:string,value:double>"
PAIR_SQL = "e as (select event_id, user_id, value, event_id % 9 = 0 as moved, user_id::varchar as a0, '1' || event_id as b0, user_id || '1' as a1, event_id::varchar as b1 from events where event_id <= 900)"


def _pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id <= 900")
    old = F.struct(F.col("user_id").cast("string").alias("a"), F.concat(F.lit("1"), "event_id").alias("b"), "value").cast(PAIR)
    new = F.struct(F.concat("user_id", F.lit("1")).alias("a"), F.col("event_id").cast("string").alias("b"), "value").cast(PAIR)
    zero = F.lit(0).cast("bigint")
    return e.select(F.col("event_id").alias("commit_lsn"), zero.alias("xid"), zero.alias("sub_xid"), zero.alias("seq"), F.lit("U").alias("op"), old.alias("before"), F.when(F.col("event_id") % 9 == 0, new).otherwise(old).alias("after"), F.array().cast("array<string>").alias("masked"))


@add(f"with {PAIR_SQL} select case when moved then a1 else a0 end as a, case when moved then b1 else b0 end as b, value from e")
def composite_key_move(spark, sf_dir):
    """A change of a key of two columns deletes the old row, also where both keys read alike end to end."""
    events = _pairs(spark, sf_dir)
    target = events.select("before.*").withColumn("value", F.lit(-1.0))
    return cdc.apply_merge(target, cdc.collapse(events, ["a", "b"], masks=False))


@add(f"""with {PAIR_SQL} select 'D' as _op, event_id as _lsn, 1::bigint as _seq, a0 as a, b0 as b, value from e where moved
union all select 'U', event_id, case when moved then 2 else 1 end::bigint, case when moved then a1 else a0 end, case when moved then b1 else b0 end, value from e""")
def composite_changelog(spark, sf_dir):
    return changelog.capture(_pairs(spark, sf_dir), ["a", "b"], masks=False).drop("_at")


@add("select l_orderkey, l_linenumber, l_quantity from lineitem l where not exists (select 1 from lineitem r where r.l_returnflag = 'R' and r.l_orderkey = l.l_orderkey and r.l_linenumber = l.l_linenumber)")
def delete_by_tuple_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    return without_keys(lines.select(*keys, "l_quantity"), lines.where("l_returnflag = 'R'"), keys)


MOVES_SQL = "f as (select user_id, min(event_id) as event_id from events where event_id % 9 = 0 group by 1)"


@add(f"""with {MOVES_SQL} select 1000000 + e.event_id as user_id, e.value, 'old' as event_type from f join events e using (event_id)
union all select distinct user_id, -1.0::double, 'old' from events where user_id not in (select user_id from f)""")
def masked_key_move(spark, sf_dir):
    """Rows that move to another key with a cell left out take it from where they were."""
    e = table(spark, sf_dir, "events")
    first = e.where("event_id % 9 = 0").groupBy("user_id").agg(F.min_by(F.struct("event_id", "value"), "event_id").alias("f")).select("user_id", "f.*")
    row = lambda key, value, kind: F.struct(key.alias("user_id"), value.alias("value"), kind.alias("event_type")).cast(changes.ROW)
    zero, none = F.lit(0).cast("bigint"), F.lit(None)
    moves = first.select(F.col("event_id").alias("commit_lsn"), zero.alias("xid"), zero.alias("sub_xid"), zero.alias("seq"), F.lit("U").alias("op"), row(F.col("user_id"), none, none).alias("before"), row(F.col("event_id") + 1_000_000, F.col("value"), none).alias("after"), F.array(F.lit("event_type")).alias("masked"))
    return cdc.apply_merge(changes.target(spark, sf_dir, every=True), cdc.collapse(moves, ["user_id"]))


@add("select user_id, arg_max(value, event_id) as value, arg_max(event_type, event_id) as event_type from events group by 1")
def follow_split_transaction(spark, sf_dir):
    """One commit over 20 files, with windows of 3 files: nothing is lost, and nothing shows before it is whole."""
    root = scratch(spark)
    put(spark, f"{root}/server.json", json.dumps({"server": "test", "snapshot_lsn": 0, "tables": {"users": {"pk": ["user_id"]}}}))
    changes.target(spark, sf_dir, every=True).write.parquet(f"{root}/users/snapshot")
    e = table(spark, sf_dir, "events")
    row = F.struct("user_id", "value", "event_type").cast(changes.ROW)
    zero = F.lit(0).cast("bigint")
    log = e.select(F.lit(7).cast("bigint").alias("commit_lsn"), zero.alias("xid"), zero.alias("sub_xid"), F.col("event_id").alias("seq"), F.lit("U").alias("op"), F.lit(None).cast(changes.ROW).alias("before"), row.alias("after"), F.array().cast("array<string>").alias("masked"))
    log.repartitionByRange(20, "seq").write.parquet(f"{root}/users/log")
    lake = Lake(spark, f"{root}/lake")
    drain.follow(drain.ChangeLog(spark, root), lake, ["users"], f"{root}/ck", files=3)
    return lake.table("users").frame()


def _refused(f, *args, **kwargs) -> bool:
    try:
        f(*args, **kwargs)
    except (InvalidInput, TransferError):
        return True
    except Exception as e:  # noqa: BLE001
        return "change without a value for key column" in str(e) or "unknown change op" in str(e)
    return False


CASES = {
    "null key": True, "unknown op": True, "no key": True, "identity lacks key": True, "shape: replica as changelog": True, "shape: same": False, "half a changelog": True, "reserved names": True,
    "changelog of objects": True, "append to objects": True, "position too old": True, "position beyond the end": True, "position within": False, "log settings": True, "log settings fine": False, "schema changed": True,
    "same schema": False, "torn group": True, "two destinations": True, "helper as source": True, "helper of another": True, "plain names": False, "two selectors": True, "table twice": True, "unknown mode": True,
    "no table": True, "slots 0": True, "parallel 0": True, "changelog by replace": True, "order_by with a quote": True, "engine of another family": True, "cursor of text": True, "cursor unknown": True, "no cursor": True,
    "drift": True, "sibling without state": True, "watermark no number": True, "iceberg": True, "bigquery": True, "unknown sink": True, "partition unknown": True,
}


@add("select * from (values " + ", ".join(f"('{k}', {str(v).lower()})" for k, v in CASES.items()) + ") t(name, refused)")
def refusals(spark, sf_dir):
    """What is refused before anything is touched, and what isn't."""
    region = table(spark, sf_dir, "region")
    schema = StructType([StructField("k", LongType()), StructField("t", StringType())])
    row = "struct<k:bigint,t:string>"
    one = lambda op, after: spark.createDataFrame([(1, 1, 0, 0, op, None, after, [])], cdc.event_schema(schema))
    run = lambda op, after: cdc.collapse(one(op, after), ["k"], masks=False).states.collect()
    options, probe = spec.TransferOptions, spec.TableSpec("x", schema)
    meta, dst = [*changelog.META, "k"], "lake://" + scratch(spark)
    move = lambda where=dst, **o: transfer(spark, {"region": region}, where, **{"table": "region", **o})
    got = {
        "null key": _refused(run, "U", (None, "x")), "unknown op": _refused(run, "X", (1, "x")), "no key": _refused(cdc.check_table, schema, []), "identity lacks key": _refused(cdc.check_table, schema, ["k", "t"], ["k"]),
        "shape: replica as changelog": _refused(changelog.check_shape, ["k"], True), "shape: same": _refused(changelog.check_shape, meta, True), "half a changelog": _refused(changelog.is_changelog, ["_op", "k"]), "reserved names": _refused(changelog.check_names, ["k", "_Op"]),
        "changelog of objects": _refused(transfer, spark, f"log://{dst}", "parquet://x", table="t", mode="log_based"), "append to objects": _refused(move, "parquet://" + dst[7:], mode="append", cursor="r_regionkey"),
        "position too old": _refused(guards.check_position, 5, 10, 20), "position beyond the end": _refused(guards.check_position, 25, 10, 20), "position within": _refused(guards.check_position, 9, 10, 20),
        "log settings": _refused(guards.check_settings, {"binlog_format": "MIXED"}), "log settings fine": _refused(guards.check_settings, {"wal_level": "logical", "other": "x"}), "schema changed": _refused(guards.check_schema, schema, region.schema), "same schema": _refused(guards.check_schema, schema, schema),
        "torn group": _refused(drain.group_start, {"a": 1, "b": None}), "two destinations": _refused(naming.check_destinations, ["a", "a"]), "helper as source": _refused(naming.check_destinations, [naming.helper_name("a", naming.Helper.STAGING)]), "helper of another": _refused(naming.check_destinations, ["a", "a__current"]), "plain names": _refused(naming.check_destinations, ["a", "b__current"]),
        "two selectors": _refused(spec.select_tables, "a", ["b"], None, "replace"), "table twice": _refused(spec.select_tables, None, ["a", "a"], None, "replace"), "unknown mode": _refused(spec.select_tables, "a", None, None, "upsert"), "no table": _refused(spec.select_tables, None, [], None, "replace"),
        "slots 0": _refused(options(slots=0).checked), "parallel 0": _refused(options(parallel=0).checked), "changelog by replace": _refused(options(changelog=True).checked), "order_by with a quote": _refused(options(order_by="a'; drop").checked), "engine of another family": _refused(options(engine="Log").checked),
        "cursor of text": _refused(probe.cursor, "t"), "cursor unknown": _refused(probe.cursor, "nope"), "no cursor": _refused(probe.cursor, None), "drift": _refused(check_drift, region, region.withColumn("r_name", F.lit(1))), "sibling without state": _refused(watermark.resolve, None, "9", True, watermark.Trust.STATE),
        "watermark no number": _refused(watermark.literal, "x", LongType()), "iceberg": _refused(move, "iceberg://x"), "bigquery": _refused(move, "bigquery://x"), "unknown sink": _refused(move, "ftp://x"), "partition unknown": _refused(move, partition_by="no_such_column + 1"),
    }
    assert row and set(got) == set(CASES)
    return spark.createDataFrame(list(got.items()), "name string, refused boolean")


NAMES = {
    "helper": "t__lodeworks_staging", "long helper bytes": "63", "long helpers differ": "True", "identity": "postgres://h:5432/db::public.t", "identity alike": "True", "redacted": "jdbc:x://***@h/db?password=***", "server marks differ": "True",
    "pick later": "9", "pick number over junk": "9", "pick by number": "10", "later of none": "5", "groups": "a b|c d e", "least mark": "3", "partition of a table": "m", "partition of the rest": "y", "mode order": "replace append merge log_based", "ddl": "True", "dml": "False",
}


@add("select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in NAMES.items()) + ") t(name, value)")
def names_and_rules(spark, sf_dir):
    """Helper names within a limit, identities without credentials, watermark comparison, groups, clauses by table."""
    long = ["x" * 80 + tail for tail in "ab"]
    short = [naming.helper_name(n, naming.Helper.STAGING, naming.POSTGRES_LIMIT) for n in long]
    me = [identity.source_identity(u, t) for u, t in (("postgresql://u:p@h/db", "t"), ("postgres://h:5432/db", "public.t"))]
    o = spec.TransferOptions(partition_by={"t": "m", "*": "y"})
    pairs, _ = spec.select_tables(None, {"d": "log_based", "c": "merge", "b": "append", "a": "replace"}, None, "replace")
    got = {
        "helper": naming.helper_name("t", naming.Helper.STAGING), "long helper bytes": len(short[0].encode()), "long helpers differ": short[0] != short[1], "identity": me[0], "identity alike": me[0] == me[1], "redacted": identity.redacted("jdbc:x://u:p@h/db?password=p"),
        "server marks differ": S.server_mark("a") != S.server_mark("b"), "pick later": watermark.pick(True, "5", "9"), "pick number over junk": watermark.pick(True, "junk", "9"), "pick by number": watermark.pick(True, "10", "9"), "later of none": watermark.later(None, "5", True),
        "groups": "|".join(" ".join(g) for g in drain.cut_groups("edcba", 2)), "least mark": drain.group_start({"a": 3, "b": 5}), "partition of a table": o.partition_for("s.t"), "partition of the rest": o.partition_for("u"), "mode order": " ".join(m.value for _, m in pairs),
        "ddl": guards.is_ddl("/* x */ ALTER TABLE t ADD c int"), "dml": guards.is_ddl("BEGIN"),
    }
    return spark.createDataFrame([(k, str(v)) for k, v in got.items()], "name string, value string")


@add("""select event_id, user_id from events where (value > 90 or event_type = 'purchase') and not (event_id % 2 = 0) and ts::date <> date '2024-01-03' and (event_id > 10) = true and -event_id % 7 <> -3""")
def or_predicate(spark, sf_dir):
    """OR, NOT, a boolean and a date literal, the remainder of a negative number."""
    e = table(spark, sf_dir, "events")
    return e.where("(value > 90 or event_type = 'purchase') and not (event_id % 2 = 0) and cast(ts as date) <> date '2024-01-03' and (event_id > 10) = true and -event_id % 7 <> -3").select("event_id", "user_id")


@add("""select event_id, (event_id + 0.5)::decimal(12,1)::varchar as widened, event_id::double > 10.5 as above from events where event_id < 300 and event_id > 2.5""")
def cast_rule(spark, sf_dir):
    """Whole numbers meet decimals and doubles in the wider type."""
    return table(spark, sf_dir, "events").where("event_id < 300 and event_id > 2.5D").selectExpr("event_id", "cast(cast(event_id + 0.5 as decimal(12,1)) as string) as widened", "cast(event_id as double) > 10.5D as above")


@add("""with x as (select event_id, case when event_id % 3 = 0 then 'nan'::double when event_id % 3 = 1 then value end as v from events where event_id < 300)
select event_id, v = 'nan'::double as same, v > 1e300 as greater from x""")
def nan_rule(spark, sf_dir):
    """NaN equals itself and is greater than all numbers; null stays null."""
    v = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 3 == 1, F.col("value"))
    return table(spark, sf_dir, "events").where("event_id < 300").select("event_id", v.alias("v")).selectExpr("event_id", "v = double('NaN') as same", "v > 1e300D as greater")


@add("select least(7, count(*)) as n, true as fits from events where value > 50")
def head_limit(spark, sf_dir):
    """A filter and a limit without an order: so many rows, all of them fit."""
    return table(spark, sf_dir, "events").where("value > 50").limit(7).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("value") > 50).alias("fits"))


@add("""select * from (values (1, '0.000100020003'), (2, '100000000000000000000.000000000000'), (3, '12340005.000600000000'), (4, '0.000000000000'), (5, '-1.500000000000')) t(id, v)""")
def base10000_decimals(spark, sf_dir):
    rows = [(1, [1, 2, 3], -1, False), (2, [1], 5, False), (3, [1234, 5, 6], 1, False), (4, [], 0, False), (5, [1, 5000], 0, True)]
    df = spark.createDataFrame(rows, "id int, g array<int>, w int, minus boolean")
    v = S.from_base10000(F.col("g"), F.col("w"), 12)
    return df.select("id", F.when(F.col("minus"), -v).otherwise(v).cast(DecimalType(38, 12)).cast("string").alias("v"))


@add("""select event_id, case when event_id % 2 = 0 then '1' else '0' end as flag, bin(event_id) as bits, event_id % 2 = 1 as back,
(ts::date)::varchar as day, (event_id / 4)::decimal(10,2)::varchar as dec, case when event_id % 3 = 0 then '-' else '' end || lpad((event_id * 37 // 3600)::varchar, 2, '0') || ':' || lpad((event_id * 37 // 60 % 60)::varchar, 2, '0') || ':' || lpad((event_id * 37 % 60)::varchar, 2, '0') as clock
from events where event_id between 1 and 400""")
def typed_text(spark, sf_dir):
    """Booleans, bits, dates, decimals, bytes and signed times, to text and back."""
    e = table(spark, sf_dir, "events").where("event_id between 1 and 400")
    n = F.col("event_id")
    sign = F.when(n % 3 == 0, -1).otherwise(1)
    raw = F.concat(F.lit("\\x"), F.when(n % 2 == 1, "74").otherwise("66"))
    return e.select("event_id", S.bool_to_text(n % 2 == 0).alias("flag"), S.bit_text(n).alias("bits"), S.bool_from_text(S.typed(raw, "binary").cast("string")).alias("back"), S.typed(F.date_format("ts", "yyyy-MM-dd"), "date").cast("string").alias("day"), S.typed((n / 4).cast("string"), "decimal(10,2)").cast("string").alias("dec"), S.signed_time(n * 37 * sign).alias("clock"))


def _entity(name):
    """A query for one API entity: objects from nation, in wrapped pages where the API wraps them."""
    columns = ENTITIES[name]["columns"][:-1]
    text = {"long": "n_nationkey + {i}", "tail": "n_nationkey", "bool": "n_nationkey % 2 = 0", "time": "timestamp '2024-01-01 00:00:00' + {day}", "text": "n_name || '{c}'", "json": "n_name"}

    def expr(c, kind, i, duck):
        if kind == "json":
            return "'[\"' || n_name || '\"]'" if duck else "array(n_name)"
        day = "to_days(n_nationkey)" if duck else "make_interval(0, 0, 0, n_nationkey)"
        out = text[kind].format(i=i, c=c, day=day)
        return f"({out})::{'bigint' if kind in ('long', 'tail') else 'timestamptz' if kind == 'time' else 'varchar' if kind == 'text' else 'boolean'}" if duck and kind != "time" else out

    def query(spark, sf_dir):
        tree: dict = {}
        for i, (c, kind, path) in enumerate(columns):
            at = tree
            for p in path[:-1]:
                at = at.setdefault(p, {})
            value = F.expr("n_nationkey" if path[-1] == "issue_url" else expr(c, kind, i, False))
            at[path[-1]] = F.concat(F.lit("https://x/y/"), value.cast("string")) if kind == "tail" or (path[-1] == "issue_url") else F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'") if kind == "time" else value
        build = lambda t: F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in t.items()])
        pages = table(spark, sf_dir, "nation").groupBy((F.col("n_nationkey") % 3).alias("page")).agg(F.collect_list(build(tree)).alias("all"))
        wrap = ENTITIES[name].get("wrap")
        body = F.to_json(F.struct(F.lit(1).alias("total_count"), F.col("all").alias(wrap))) if wrap else F.to_json("all")
        rows = entity_frame(pages.select(body.alias("value")), name).drop("raw")
        return rows.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if kind == "time" else F.col(c) for c, kind, _ in columns])

    def shown(c, kind, i):
        if c == "issue_url":
            return "'https://x/y/' || n_nationkey"
        return f"strftime({expr(c, kind, i, True)}, '%Y-%m-%d %H:%M:%S')" if kind == "time" else expr(c, kind, i, True)

    query.__name__ = f"api_all_{name}"
    add("select " + ", ".join(f"{shown(c, kind, i)} as {c}" for i, (c, kind, _) in enumerate(columns)) + " from nation")(query)


for _name in ENTITIES:
    _entity(_name)


@add("select n_nationkey::varchar as key, case when n_regionkey = 0 then null else n_name end as col_2 from nation")
def sheet_tab(spark, sf_dir):
    """A tab in two pages; a blank header gets a name, empty cells are null."""
    root = scratch(spark)
    rows = [[str(r.n_nationkey), "" if r.n_regionkey == 0 else r.n_name] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    put(spark, f"{root}/tab/1.json", json.dumps({"values": [["key", " "], *rows[:10]]}))
    put(spark, f"{root}/tab/2.json", json.dumps({"values": rows[10:]}))
    return read(spark, f"sheets://{root}", "tab").lazy()


@add("select 'n_name' as name, 'string' as type, 25::bigint as n, (select sum(n_nationkey) from nation)::bigint as total union all select 'n_nationkey', 'int', 25, (select sum(n_nationkey) from nation)")
def reader_outputs(spark, sf_dir):
    """A probe of the schema, Arrow batches, and a Parquet copy of one reader."""
    r = read(spark, f"parquet://{sf_dir}", "nation", columns=["n_name", "n_nationkey"])
    at = f"{scratch(spark)}/copy.parquet"
    n = r.to_parquet(at)
    total = sum(sum(b.column("n_nationkey").to_pylist()) for b in r.batches(10))
    assert n == r.to_arrow().num_rows == spark.read.parquet(at).count()
    return spark.createDataFrame([(name, kind, n, total) for name, kind, _ in r.schema], "name string, type string, n long, total long")


@add("select s_suppkey, s_name, s_nationkey::bigint as s_nationkey from supplier")
def object_parquet(spark, sf_dir):
    root = scratch(spark)
    transfer(spark, {"supplier": table(spark, sf_dir, "supplier").drop("s_acctbal")}, f"parquet://{root}", table="supplier")
    return read(spark, f"parquet://{root}", "supplier").lazy()


@add("select 'nation' as name, 'replace' as mode, (select count(*) from nation) as rows union all select 'orders', 'append', (select count(*) from orders) union all select 'region', 'merge', (select count(*) from region) union all select 'users', 'log_based', (select count(distinct user_id) from events)")
def mixed_modes(spark, sf_dir):
    """A mode for each table, one of them by the log, in the order of the modes."""
    root = scratch(spark)
    put(spark, f"{root}/server.json", json.dumps({"server": "s", "snapshot_lsn": 0, "tables": {"users": {"pk": ["user_id"]}, "nation": {"pk": ["n_nationkey"]}, "region": {"pk": ["r_regionkey"]}, "orders": {"pk": ["o_orderkey"]}}}))
    for t in ("nation", "region", "orders"):
        table(spark, sf_dir, t).write.parquet(f"{root}/{t}/snapshot")
    changes.target(spark, sf_dir, every=True).write.parquet(f"{root}/users/snapshot")
    changes.log(spark, sf_dir).limit(0).write.parquet(f"{root}/users/log")
    report = transfer(spark, f"log://{root}", f"lake://{root}/lake", tables={"users": "log_based", "region": "merge", "orders": "append", "nation": "replace"})
    assert [t.mode for t in report.tables] == ["replace", "append", "merge", "log_based"]
    return report.frame(spark).select(F.col("table").alias("name"), "mode", "rows")


@add("select 'event_id' as cursor, max(event_id)::varchar as watermark, 'append' as mode, count(*) filter (where event_id > 100) as rows, 1::bigint as states from events")
def lake_state(spark, sf_dir):
    """The state that an append leaves: greatest cursor and rows, both counted while writing; a null cursor never syncs."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    dst = scratch(spark)
    opts = dict(table="events", cursor="event_id", pk=("event_id",))
    transfer(spark, {"events": e.where("event_id <= 100")}, f"lake://{dst}", mode="append", **opts)
    nothing = e.limit(1).select(F.lit(None).cast("bigint").alias("event_id"), "value")
    transfer(spark, {"events": e.unionByName(nothing)}, f"lake://{dst}", mode="append", **opts)
    state = Lake(spark, dst).table("events").version().state
    return spark.createDataFrame([(s["cursor"], s["watermark"], s["mode"], s["rows"], len(state)) for s in state.values()], "cursor string, watermark string, mode string, rows long, states long")


@add("select c_custkey, case when c_custkey % 2 = 0 then 'new' else c_name end as c_name from customer")
def lake_partitioned_merge(spark, sf_dir):
    """A partitioned table keeps its partitions in append and merge; the key is the destination's."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    dst = "lake://" + scratch(spark)
    opts = dict(table="customer", cursor="c_custkey", partition_by="c_custkey % 3")
    transfer(spark, {"customer": c.where("c_custkey <= 50")}, dst, pk=("c_custkey",), **opts)
    transfer(spark, {"customer": c}, dst, mode="append", **opts)
    start = spark.createDataFrame([(-1, "x")], c.schema)
    lake = Lake(spark, dst[7:]).table("customer")
    lake.merge(c.where("c_custkey % 2 = 0").withColumn("c_name", F.lit("new")), "s", "c_custkey")
    lake.merge(start, "s", "c_custkey", deletes=start)
    return read(spark, dst, "customer").lazy().where("c_custkey >= 0")


@add("select s_suppkey as k, s_name as name, s_acctbal as bal from supplier")
def jdbc_roundtrip(spark, sf_dir):
    """Into a database by replace, append and merge, and back in ranges of the key."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("K"), F.col("s_name").alias("NAME"), F.col("s_acctbal").alias("BAL"))
    opts = dict(table="SUPP", cursor="K", pk=("K",))
    transfer(spark, {"SUPP": s.where("K <= 4").withColumn("NAME", F.lit("old"))}, url, **opts)
    transfer(spark, {"SUPP": s}, url, mode="append", **opts)
    transfer(spark, {"SUPP": s.unionByName(s.where("K <= 4").withColumn("K", F.col("K") + 1_000_000))}, url, mode="merge", **opts)
    transfer(spark, {"SUPP": s}, url, **opts)
    back = read(spark, url, "SUPP", cursor="K", parallel=2).lazy()
    assert read(spark, url, query="select count(*) as N from SUPP").lazy().first()[0] == back.count()
    return back.select(F.col("K").alias("k"), F.col("NAME").alias("name"), F.col("BAL").alias("bal"))


@add("select 1::bigint as kept, 0::bigint as gone")
def vacuum_keeps_running_writers(spark, sf_dir):
    """A staged folder that no version names yet stays until it is old."""
    t = Lake(spark, scratch(spark)).table("region")
    t.replace(table(spark, sf_dir, "region"), "s")
    t._write(table(spark, sf_dir, "region"), None, None, None)
    early = t.vacuum()
    time.sleep(0.01)
    return spark.createDataFrame([(t.vacuum(older_than=0), early)], "kept long, gone long")



