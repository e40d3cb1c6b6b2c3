"""Mixing sources to target weights by hierarchical budgeting."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeworks.llm.common import free, landed

DOMAIN = "concat('d', cast(pmod(coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int), 0), 4) as string))"
DOMAIN_DUCK = "'d' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int), 0) % 4)::varchar"
PRODUCTION = dict(
    domain=DOMAIN,
    domain_weights={"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    lang_weights={"en": 6, "de": 2, "fr": 1, "es": 1},
    source_weights={},
    budget_share=0.8,
    max_epochs=2,
    seed="mix-1",
)
BUCKET_HEX = 3


def _weight(name: str, weights: dict[str, int]) -> str:
    cases = " ".join(f"when {name} = '{k}' then {int(v)}" for k, v in weights.items())
    return f"cast(case {cases} else 1 end as bigint)" if cases else "cast(1 as bigint)"


def _fill(frame: str, parent: str, child: str, budget: str, source: str, wide: str) -> str:
    """SQL of one level: share each parent's budget among its children by weight,
    none above its capacity; what a full child leaves goes to its siblings.

    Children are ordered by capacity / weight, so the full ones come first and
    one pass of window sums finds the fill level. Amounts are whole tokens.
    """
    part = f"partition by {parent}" if parent else ""
    keys = ", ".join(x for x in (parent, child) if x)
    return f"""
{frame}_o as (
  select {keys}, w, cap, budget,
         coalesce(sum(cap) over ({part} order by cap * 1.0e0 / nullif(w, 0) nulls last, {child} rows between unbounded preceding and 1 preceding), 0) as before,
         sum(w) over ({part} order by cap * 1.0e0 / nullif(w, 0) nulls last, {child} rows between current row and unbounded following) as open_w
  from {source}),
{frame}_f as (
  select *, w > 0 and cast(budget - before as {wide}) * w >= cast(cap as {wide}) * open_w as is_full from {frame}_o),
{frame}_s as (
  select *, coalesce(sum(case when is_full then cap end) over ({part}), 0) as full_cap,
            coalesce(sum(case when is_full then 0 else w end) over ({part}), 0) as rest_w
  from {frame}_f),
{frame} as (
  select {keys}, cap, cast(case when is_full then cap when w = 0 or rest_w = 0 then 0
         else least(cast(cap as {wide}), floor({{div}})) end as bigint) as alloc
  from {frame}_s)"""


def budget_sql(leaves: str, total: str, p: dict, duck: bool) -> str:
    """CTEs that end in `plan`: domain, lang, source, tokens, alloc.

    Top down, with the capacity of a node being the sum of its leaves: a short
    leaf's remainder therefore stays with its siblings, and reaches another
    branch only when the whole parent is short.
    """
    wide = "hugeint" if duck else "decimal(38,0)"
    num = f"cast(budget - full_cap as {wide}) * w"
    div = f"{num} // rest_w" if duck else f"({num} - pmod({num}, rest_w)) / rest_w"
    fill = lambda *a: _fill(*a, wide).replace("{div}", div)
    return f"""
leaf as (select domain, lang, source, tokens, tokens * {p['max_epochs']} as cap from {leaves}),
dom_in as (select domain, {_weight('domain', p['domain_weights'])} as w, cast(sum(cap) as bigint) as cap, {total} as budget from leaf group by domain),
{fill('dom', '', 'domain', 'budget', 'dom_in')},
lang_in as (select l.domain, l.lang, {_weight('l.lang', p['lang_weights'])} as w, l.cap, d.alloc as budget
  from (select domain, lang, cast(sum(cap) as bigint) as cap from leaf group by domain, lang) l join dom d on l.domain = d.domain),
{fill('lng', 'domain', 'lang', 'budget', 'lang_in')},
src_in as (select l.domain, l.lang, l.source, {_weight('l.source', p['source_weights'])} as w, l.cap, g.alloc as budget
  from leaf l join lng g on l.domain = g.domain and l.lang = g.lang),
{fill('src', 'domain, lang', 'source', 'budget', 'src_in')},
plan as (select s.domain, s.lang, s.source, l.tokens, s.alloc
  from src s join leaf l on s.domain = l.domain and s.lang = l.lang and s.source = l.source)"""


def _order(seed: str, epoch: Column, doc: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("null"))))


def mix(docs: DataFrame, carry: bool = False, **changes) -> DataFrame:
    """The documents, epoch by epoch, that make the mixture.

    The tree is domain (an SQL expression over the columns), language, source.
    Each node's weight is relative to its siblings (1 where none is given). The
    budget is budget_share of all tokens; a leaf can give max_epochs times what
    it holds. Tokens are runs without white space. A leaf gives whole epochs,
    then the longest prefix that fits of the next epoch, whose order comes from
    md5(seed:epoch:doc_id), then doc_id.

    Returns doc_id, epoch, domain, lang, source, n_tokens, or with carry=True
    the columns of docs, a row for each time a document is taken.
    Nulls: a null lang or source is a leaf named ''; a null text has 0 tokens;
    a null doc_id counts as the string 'null'. Rows of one doc_id and size go by
    the hash of their text. Texts count whole, however long. Empty texts cost nothing and come
    along while the prefix lasts. Rows that are alike are counted each. An empty
    table gives an empty result. Only the columns doc_id, text, lang and source
    are read by name; others, whatever their names, pass through (carry) or are
    ignored.

    No window ever spans a leaf: each epoch's order is cut into 4096 buckets by
    the hash, bucket sums give the bucket in which the prefix ends, and only
    that bucket is sorted.
    """
    p = {**PRODUCTION, **changes}
    spark = docs.sparkSession
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    names = docs.columns
    n = {k: free([*names, "domain"], "_" + k) for k in ("domain", "lang", "source", "tokens", "doc", "text")}
    base = docs if carry else docs.select("doc_id", "text", "lang", "source")
    base = (
        base.withColumn(n["domain"], F.expr(p["domain"]))
        .withColumn(n["lang"], blank("lang"))
        .withColumn(n["source"], blank("source"))
        .withColumn(n["tokens"], F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("bigint"))
        .withColumn(n["doc"], F.col("doc_id"))
        .withColumn(n["text"], F.xxhash64("text"))
    )
    base = base.withColumn(n["domain"], F.coalesce(n["domain"], F.lit("")))
    keys = [n["domain"], n["lang"], n["source"]]
    slim = landed(base.select(*[F.col(c).alias(a) for a, c in (("domain", keys[0]), ("lang", keys[1]), ("source", keys[2]), ("tokens", n["tokens"]), ("doc", n["doc"]), ("th", n["text"]))]), "tokens")
    leaves = landed(slim.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("tokens")), "leaves")
    view = f"lodeworks_leaves_{uuid.uuid4().hex}"
    leaves.createOrReplaceTempView(view)
    share = int(round(p["budget_share"] * 1_000_000))
    total = f"(select cast(coalesce(sum(cast(tokens as decimal(38,0)) * {share}), 0) div 1000000 as bigint) from {view})"
    plan = spark.sql(f"with {budget_sql(view, total, p, False)} select * from plan")
    plan = plan.withColumn("whole", F.expr("case when tokens = 0 then 0 else alloc div tokens end").cast("int")).withColumn("rest", F.expr("case when tokens = 0 then 0 else alloc - tokens * (alloc div tokens) end"))
    plan = landed(plan.select("domain", "lang", "source", "whole", "rest"), "plan")
    spark.catalog.dropTempView(view)

    on = ["domain", "lang", "source"]
    bucket = F.substring(_order(p["seed"], F.col("whole"), F.col("doc")), 1, BUCKET_HEX)
    sums = slim.join(plan, on).groupBy(*on, "rest", bucket.alias("bucket")).agg(F.sum("tokens").alias("t"))
    run = W.partitionBy(*on).orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("t").over(run))
    edge = sums.where("upto > rest").groupBy(*on).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("t")).alias("before")), "bucket").alias("e"))
    plan = landed(plan.join(edge, on, "left").select(*on, "whole", "rest", F.coalesce("e.bucket", F.lit("~")).alias("edge"), F.coalesce("e.before", F.lit(0)).alias("before")), "edges")

    x = {k: free([*base.columns], f"_p_{k}") for k in ("domain", "lang", "source", "whole", "rest", "edge", "before", "hash", "epoch", "upto", "take")}
    plan = plan.select(*[F.col(k).alias(x[k]) for k in ("domain", "lang", "source", "whole", "rest", "edge", "before")])
    side = base if carry else slim.select(F.col("doc").alias("doc_id"), F.col("lang"), F.col("source"), F.col("domain").alias(n["domain"]), F.col("lang").alias(n["lang"]), F.col("source").alias(n["source"]), F.col("tokens").alias(n["tokens"]), F.col("doc").alias(n["doc"]), F.col("th").alias(n["text"]))
    rows = side.join(plan, (F.col(keys[0]) == F.col(x["domain"])) & (F.col(keys[1]) == F.col(x["lang"])) & (F.col(keys[2]) == F.col(x["source"])))
    rows = rows.withColumn(x["hash"], _order(p["seed"], F.col(x["whole"]), F.col(n["doc"])))
    cell = F.substring(x["hash"], 1, BUCKET_HEX)
    sure = F.when(F.col(x["whole"]) > 0, F.sequence(F.lit(0), F.col(x["whole"]) - 1)).otherwise(F.array().cast("array<int>"))
    sure = F.concat(sure, F.when(cell < F.col(x["edge"]), F.array(F.col(x["whole"]))).otherwise(F.array().cast("array<int>")))
    first = rows.withColumn(x["epoch"], F.explode(sure))
    last = rows.where(cell == F.col(x["edge"]))
    order = W.partitionBy(*keys).orderBy(x["hash"], F.col(n["doc"]).asc_nulls_first(), n["tokens"], n["text"]).rowsBetween(W.unboundedPreceding, 0)
    last = last.withColumn(x["upto"], F.sum(n["tokens"]).over(order) + F.col(x["before"])).where(F.col(x["upto"]) <= F.col(x["rest"])).withColumn(x["epoch"], F.col(x["whole"])).drop(x["upto"])
    out = first.unionByName(last)
    if carry:
        return out.select(*[F.col(f"`{c}`") for c in names])
    return out.select("doc_id", F.col(x["epoch"]).alias("epoch"), F.col(n["domain"]).alias("domain"), F.col(n["lang"]).alias("lang"), F.col(n["source"]).alias("source"), F.col(n["tokens"]).alias("n_tokens"))


def mixing_sql(**changes) -> str:
    p = {**PRODUCTION, **changes}
    share = int(round(p["budget_share"] * 1_000_000))
    return f"""
with d as (select doc_id, coalesce({DOMAIN_DUCK}, '') as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::bigint as n_tokens from documents),
lv as (select domain, lang, source, sum(n_tokens)::bigint as tokens from d group by all),
{budget_sql('lv', f"(select (coalesce(sum(tokens::hugeint * {share}), 0) // 1000000)::bigint from lv)", p, True)},
pl as (select *, case when tokens = 0 then 0 else alloc // tokens end as whole, case when tokens = 0 then 0 else alloc % tokens end as rest from plan),
e as (select d.*, pl.whole, pl.rest, unnest(generate_series(0, pl.whole)) as epoch from d join pl using (domain, lang, source)),
o as (select *, sum(n_tokens) over (partition by domain, lang, source, epoch
        order by md5('{p['seed']}:' || epoch || ':' || coalesce(doc_id::varchar, 'null')), doc_id nulls first, n_tokens rows unbounded preceding) as upto from e)
select doc_id, epoch::int as epoch, domain, lang, source, n_tokens from o where epoch < whole or upto <= rest
"""
