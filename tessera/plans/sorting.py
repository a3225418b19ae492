"""Sort, limit, top-k and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import paging
from tessera.operators.latest import top_per
from tessera.registry import query
from tessera.tables import table


@query("select o_orderkey from orders order by o_orderstatus, o_totalprice desc, o_orderkey limit 50")
def sort_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy("o_orderstatus", F.col("o_totalprice").desc(), "o_orderkey").limit(50).select("o_orderkey")


@query("select o_orderkey from orders order by o_orderpriority desc, o_custkey, o_orderkey limit 40")
def sort_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields outside the whitelist are refused; only DESCEND sorts downwards."""
    order = paging.sort_columns("o_orderpriority:DESCEND,o_custkey:ASCEND", {"o_orderpriority", "o_custkey", "o_orderdate"}, "o_orderkey")
    return table(spark, sf_dir, "orders").orderBy(*order).limit(40).select("o_orderkey")


@query("select n_nationkey, n_name from nation")
def sort_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chinese collation is the order of display; the rows are the same in any order."""
    return table(spark, sf_dir, "nation", "n_nationkey", "n_name").orderBy(F.expr("n_name collate zh"), "n_nationkey")


@query("""select p_partkey from part order by length(p_name) desc, p_size % 4 desc, p_size, p_brand, p_name, p_partkey limit 30""")
def sort_rule_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest alias first, then specificity, sort order, key and alias."""
    order = [F.length("p_name").desc(), (F.col("p_size") % 4).desc(), F.col("p_size"), F.col("p_brand"), F.col("p_name"), F.col("p_partkey")]
    return table(spark, sf_dir, "part").orderBy(*order).limit(30).select("p_partkey")


@query("select l_orderkey, l_linenumber, rank from (select l_orderkey, l_linenumber, cast(row_number() over (partition by l_orderkey order by l_quantity * 2 + l_discount * 100 desc, l_linenumber, l_partkey) as integer) as rank from lineitem) where rank <= 3")
def topk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    score = F.col("l_quantity") * 2 + F.col("l_discount") * 100
    return top_per(li, ["l_orderkey"], [score.desc(), F.col("l_linenumber"), F.col("l_partkey")], n=3, rank="rank").select("l_orderkey", "l_linenumber", "rank")


@query("select p_partkey, contains(p_name, '7') as hit from part order by contains(p_name, '7') desc, p_partkey limit 50")
def topk_match_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.contains("p_name", F.lit("7")).alias("hit"))
    return p.orderBy(F.col("hit").desc(), "p_partkey").limit(50)


@query("""select p_partkey, score from (select p_partkey, case when p_brand = 'Brand#11' then 100 when p_size < 10 then 60 when p_size < 30 then 40 else 0 end + least(p_size, 12) + case when p_type like '%STEEL%' then 8 else 4 end as score from part) order by score desc, p_partkey limit 20""")
def topk_prompt_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = F.when(F.col("p_brand") == "Brand#11", 100).when(F.col("p_size") < 10, 60).when(F.col("p_size") < 30, 40).otherwise(0)
    score = fits + F.least("p_size", F.lit(12)) + F.when(F.contains("p_type", F.lit("STEEL")), 8).otherwise(4)
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score")).orderBy(F.col("score").desc(), "p_partkey").limit(20)


@query("select o_orderkey, (select count(*) from orders where o_orderstatus = 'O') as total from orders where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey desc limit 20 offset 40")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderstatus").where("o_orderstatus = 'O'")
    return paging.page(o, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], page=3, size=20).select("o_orderkey", "total")


@query("""with c as (select o_orderdate, o_orderkey from orders where o_orderkey = 100)
select o.o_orderkey from orders o, c where (o.o_orderdate < c.o_orderdate or (o.o_orderdate = c.o_orderdate and o.o_orderkey < c.o_orderkey)) order by o.o_orderdate desc, o.o_orderkey desc limit 25""")
def page_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    cursor = o.where("o_orderkey = 100").first()
    return paging.after(o, [("o_orderdate", cursor["o_orderdate"], False), ("o_orderkey", cursor["o_orderkey"], False)], 25).select("o_orderkey")


@query("select o_orderkey from orders where o_orderkey > 500 order by o_orderkey limit 100")
def page_id_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.after(table(spark, sf_dir, "orders", "o_orderkey"), [("o_orderkey", 500, True)], 100)


@query("select o_custkey, chunk, count(*) as n from (select o_custkey, (row_number() over (partition by o_custkey order by o_orderkey) - 1) // 5 as chunk from orders) group by o_custkey, chunk")
def batch_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = paging.chunks(table(spark, sf_dir, "orders", "o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")], 5)
    return o.groupBy("o_custkey", "chunk").agg(F.count(F.lit(1)).alias("n"))
