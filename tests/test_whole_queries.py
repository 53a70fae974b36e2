"""Registered queries over all rows of their tables, held against SQL of the whole job."""

import duckdb

from quernel.plans import corpus


def rows(df):
    return sorted(repr([list(x) if isinstance(x, (list, tuple)) else x for x in r]) for r in df.collect())


def want(small, sql):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "articles", "queue_entries"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return sorted(repr([list(x) if isinstance(x, (list, tuple)) else x for x in r]) for r in con.sql(sql).fetchall())


def test_pairs_of_all_orders(spark, small):
    sql = """with e as (select o_orderkey as src, least(o_custkey, o_orderkey % 500) as first, greatest(o_custkey, o_orderkey % 500) as second from orders)
    select first, second, list_sort(list(distinct src)), case when first % 2 = 0 then '2026-01-01' else '2026-05-07' end from e group by first, second"""
    got = corpus.contradiction_pairs(spark, small)
    assert rows(got) == want(small, sql)
    assert got.selectExpr("explode(sources) as s").distinct().count() == spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey").distinct().count()


def test_supplies_of_all_lines(spark, small):
    sql = """select distinct l_suppkey, 'supplies', l_partkey, 'supplied_by' from lineitem x where not exists (select 1 from lineitem y where y.l_quantity > 48 and y.l_suppkey = x.l_suppkey and y.l_partkey = x.l_partkey)"""
    assert rows(corpus.inverse_gap(spark, small)) == want(small, sql)


def test_notes_reach_all_articles(spark, small, tmp_path):
    from pyspark.sql import functions as F

    for name, n in (("articles", 900), ("queue_entries", 1800)):
        ids = spark.range(n)
        cols = (F.col("id").alias("article_id"), F.concat(F.lit("p"), "id").alias("rel"), F.lit("b").alias("body")) if name == "articles" else (F.col("id").alias("entry_id"), F.lit("note").alias("note"))
        ids.select(*cols).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus.changed_pages(spark, str(tmp_path))
    assert got.count() == 900 and got.filter("body = 'b' and failed = 0").count() == 0
    assert got.selectExpr("sum(failed + size(split(body, '\\n')) - 1) as n").first().n == 1800
