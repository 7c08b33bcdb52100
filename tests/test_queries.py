"""Every SQL-expressible query against an independent engine on the smallest tables, and plans."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from sheafmill.plans import adapters, registry, retrieval

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(list(map(plain, v))) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    assert len(set(columns)) == len(columns)
    if name in registry.ORACLE_SQL:
        want = oracle.sql(registry.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_top_score_is_bounded(spark):
    assert registry.QUERIES["hybrid_rrf_search"](spark, SF).agg({"score": "max"}).first()[0] <= round(2 / 61, 9)


def test_index_recall(spark):
    exact, found = ({(r.query_id, r.id) for r in q(spark, "/root/testdata/sf0.01").collect()} for q in (retrieval.dense_topk_batch, retrieval.dense_index_search))
    assert len(exact & found) / len(exact) >= 0.9


def test_filters_reach_the_scan(spark):
    df = adapters.table(spark, SF, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan
