"""Scalar functions, on columns of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.functions import scalar as S
from lodeworks.queries.common import Registry, table
from lodeworks.sources.repo_api import entity_frame

add = Registry()
QUERIES, SQL = add.queries, add.sql


@add("select event_id, event_id % 2 = 0 as flag from events where event_id < 500")
def bool_text_cast(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id < 500")
    text = F.when(F.col("event_id") % 2 == 0, F.when(F.col("event_id") % 4 == 0, "t").otherwise("1")).otherwise(F.when(F.col("event_id") % 4 == 1, "f").otherwise("FALSE"))
    return e.select("event_id", S.bool_from_text(text).alias("flag"))


@add("select c_custkey, lower(hex(c_name)) as hexed, c_name as back, to_base64(encode(c_name)) as b64 from customer")
def hex_roundtrip(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", S.hex_text(F.col("c_name")).alias("hexed"), S.from_hex(S.hex_text(F.col("c_name"))).cast("string").alias("back"), S.base64_text(F.col("c_name")).alias("b64"))


@add("select event_id, json_extract_string(props, '$.' || json_keys(props)[1]) as first_value from events")
def json_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.expr("get_json_object(props, concat('$.', json_object_keys(props)[0]))").alias("first_value"))


@add("select page_id, try_cast(nullif(regexp_extract(url, '([0-9]+)$', 1), '') as bigint) as tail from pages")
def tail_int(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.tail_number(F.col("url")).alias("tail"))


@add("select strftime(o_orderdate, '%Y%m') as month, count(*) as n from orders group by 1")
def month_partition(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(S.partition_column("o_orderdate", o.columns).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@add("""select event_id, case when event_id % 3 = 0 then '' when event_id % 3 = 1 then '""' else '"' || replace(props, '"', '""') || '"' end as field from events""")
def csv_null_rules(spark, sf_dir):
    v = F.when(F.col("event_id") % 3 == 1, "").when(F.col("event_id") % 3 == 2, F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", S.csv_field(v).alias("field"))


@add(r"""select doc_id, md5(replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r')) as digest from documents""")
def tsv_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.tsv_escaped(F.col("text"))).alias("digest"))


@add("select event_id, ts as back, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as micros, datediff('day', date '1970-01-01', ts::date)::int as days from events")
def time_text(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.concat(S.micros_text(F.col("ts")), F.lit("+00"))
    return e.select("event_id", S.typed(S.without_offset(text), "timestamp_ntz").alias("back"), S.micros_text(F.col("ts")).alias("micros"), S.epoch_days(F.col("ts").cast("date")).alias("days"))


@add("select event_id, (event_id * 65536 + 15)::bigint as n, event_id as log_file from events where event_id < 300")
def log_positions(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id < 300")
    n = F.col("event_id") * 65536 + 15
    packed = S.binlog_position(F.format_string("bin.%06d", F.col("event_id")), F.lit(4))
    return e.select("event_id", S.lsn_number(S.lsn_text(n)).alias("n"), F.shiftright(packed, 40).alias("log_file"))


@add("""select l_orderkey, l_linenumber, (['', 'one', 'two', 'three'])[least(l_linenumber, 3) + 1] as label,
concat_ws(',', case when l_linenumber & 1 <> 0 then 'a' end, case when l_linenumber & 2 <> 0 then 'b' end, case when l_linenumber & 4 <> 0 then 'c' end) as flags from lineitem where l_orderkey < 200""")
def enum_set(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").where("l_orderkey < 200")
    n = F.col("l_linenumber")
    return r.select("l_orderkey", n, S.enum_label(F.least(n, F.lit(3)), ["one", "two", "three"]).alias("label"), S.set_labels(n, ["a", "b", "c"]).alias("flags"))


@add("""select event_id as id, event_id * 10 as number, 'issue ' || event_id as title, event_type as author, user_id::varchar as body from events where event_id <= 90 and event_id % 4 <> 0""")
def api_issues(spark, sf_dir):
    """Typed rows from JSON pages of an API; pull requests are left out."""
    e = table(spark, sf_dir, "events").where("event_id <= 90")
    obj = F.struct(F.col("event_id").alias("id"), (F.col("event_id") * 10).alias("number"), F.concat(F.lit("issue "), F.col("event_id")).alias("title"), F.struct(F.col("event_type").alias("login")).alias("user"), F.col("user_id").cast("string").alias("body"), F.when(F.col("event_id") % 4 == 0, F.struct(F.lit("x").alias("url"))).alias("pull_request"))
    pages = e.groupBy((F.col("event_id") % 3).alias("page")).agg(F.to_json(F.collect_list(obj)).alias("value")).select("value")
    return entity_frame(pages, "issues").select("id", "number", "title", "author", "body")
