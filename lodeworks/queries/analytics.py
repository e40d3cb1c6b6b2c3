"""The reader's query shapes: pushed filters, groups, medians, joins, top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeworks.queries.common import Registry, table
from lodeworks.sources.base import spans

add = Registry()
QUERIES, SQL = add.queries, add.sql
CUT = "1998-03-15"


@add(f"""
select o_orderpriority, count(*) as n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
from lineitem join orders on l_orderkey = o_orderkey
where l_shipdate > timestamp '{CUT}' and o_orderdate < timestamp '{CUT}' group by 1""")
def revenue_by_priority(spark, sf_dir):
    """The question across two tables; both filters and the projections reach the scans."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") > F.lit(CUT).cast("timestamp_ntz")).select("l_orderkey", "l_extendedprice", "l_discount")
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz")).select("o_orderkey", "o_orderpriority")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@add("select event_type, count(*) as n, round(sum(value), 2) as total from events where value > 50 group by 1")
def filter_small_group(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 50")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@add("""select count(*) as n, round(sum(l_quantity), 2) as qty, round(avg(l_extendedprice), 4) as price, min(l_shipdate) as first_ship,
max(l_shipdate) as last_ship, count(distinct l_suppkey) as suppliers from lineitem""")
def multi_agg(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("price"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), F.countDistinct("l_suppkey").alias("suppliers"))


@add("select l_orderkey, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by 1")
def high_card_group(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@add("select event_type, round(median(value), 6) as median_value from events group by 1")
def exact_median(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median_value"))


@add("select p_brand, p_type, count(*) as n from part where p_brand <> 'Brand#11' group by 1, 2")
def text_filter_group(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_brand") != "Brand#11").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


@add("""with w(event_type, weight) as (values ('click', 1), ('view', 2), ('purchase', 5))
select e.event_type, count(*) as n, round(sum(value * weight), 2) as weighted from events e join w using (event_type) group by 1""")
def local_frame_join(spark, sf_dir):
    """A stored table with a frame of the caller's; Catalyst knows the frame's size and broadcasts it."""
    w = spark.createDataFrame([("click", 1), ("view", 2), ("purchase", 5)], "event_type string, weight int")
    return table(spark, sf_dir, "events").join(w, "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.expr("value * weight")), 2).alias("weighted"))


@add("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@add("""with b as (select min(o_orderkey) as lo, max(o_orderkey) as hi from orders),
w as (select lo, hi, hi - lo + 1 as width from b), s as (select unnest(range(8)) as span),
r as (select span, lo + width * span // 8 as from_key, lo + width * (span + 1) // 8 - 1 as to_key from s, w)
select span::int as span, from_key, to_key, (select count(*) from orders where o_orderkey between from_key and to_key) as n from r""")
def span_cover(spark, sf_dir):
    """A key range in eight adjoining spans, and the rows in each."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    cuts = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans(low, high, 8))], "span int, from_key long, to_key long")
    met = cuts.join(orders, F.col("o_orderkey").between(F.col("from_key"), F.col("to_key")), "left")
    return met.groupBy("span", "from_key", "to_key").agg(F.count("o_orderkey").alias("n"))


@add("""select o_orderstatus, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem join orders on l_orderkey = o_orderkey group by 1""")
def bucketed_join(spark, sf_dir):
    """Both sides cut into 16 by the hash of the key, joined bucket by bucket without another exchange, partial sums added up."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity").repartition(16, "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").repartition(16, "o_orderkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@add("""select c_mktsegment, count(*) as n, count(*) filter (where c_acctbal > 0) as positive, round(min(c_acctbal), 2) as low, round(max(c_acctbal), 2) as high
from customer group by 1""")
def filtered_counts(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("positive"), F.round(F.min("c_acctbal"), 2).alias("low"), F.round(F.max("c_acctbal"), 2).alias("high"))


@add("""select event_id, user_id, value from events where event_id % 7 = 3 and value * 2 + 1 > 100 and event_type <> 'view' and ts >= timestamp '2024-01-05'""")
def predicate_pushdown(spark, sf_dir):
    """Comparisons, arithmetic and logic over pushed columns."""
    e = table(spark, sf_dir, "events")
    return e.where((F.col("event_id") % 7 == 3) & (F.col("value") * 2 + 1 > 100) & (F.col("event_type") != "view") & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz"))).select("event_id", "user_id", "value")


ROW_TEXT = "concat_ws('|', l_orderkey, l_linenumber, l_returnflag, l_linestatus)"


@add(f"""with h as (select l_orderkey, l_returnflag, ('0x' || md5({ROW_TEXT})[1:15])::bigint as h from lineitem)
select count(*) as n, sum(l_orderkey)::bigint as keys, sum(h % 1000000007)::bigint as digest_sum, bit_xor(h) as digest_xor, count(*) filter (where l_returnflag = 'R') as returned from h""")
def source_vs_dest_digest(spark, sf_dir):
    """The digest that two copies of a table are compared by: sums and exclusive-or of row hashes, in any order, with partial combine."""
    h = F.conv(F.substring(F.md5(F.expr(ROW_TEXT)), 1, 15), 16, 10).cast("bigint")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", h.alias("h"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"), F.sum(F.col("h") % 1000000007).alias("digest_sum"), F.bit_xor("h").alias("digest_xor"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))


@add("""select n_name, round(sum(o_totalprice), 2) as total, count(distinct c_custkey) as customers
from customer join nation on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by 1""")
def three_way_join(spark, sf_dir):
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    j = o.select("o_custkey", "o_totalprice").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.countDistinct("c_custkey").alias("customers"))
