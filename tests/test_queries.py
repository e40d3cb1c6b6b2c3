import math
import os

import duckdb
import pytest

from lodeworks.queries import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, duck, name):
    got = queries()[name](spark, SF)
    sql = oracle_sql().get(name)
    cols = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    rel = duck.sql(sql)
    at = [rel.columns.index(c) for c in cols]
    assert len(rel.columns) == len(cols)
    b = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert a == b


def test_scans_are_pruned_and_filtered(spark):
    df = queries()["revenue_by_priority"](spark, SF)
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThan(l_shipdate" in plan
    assert "l_comment" not in plan and "o_totalprice" not in plan
