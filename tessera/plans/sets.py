"""Set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.latest import first_by_hash, last_by_key, top_per
from tessera.registry import query
from tessera.tables import table


def _orders(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(where).select(F.col("o_custkey").alias("id"))


@query("select 'order' as kind, o_custkey as id from orders where o_orderstatus = 'P' union all select 'event', user_id from events where event_type = 'error'")
def set_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.lit("event").alias("kind"), F.col("user_id").alias("id"))
    return _orders(spark, sf_dir, "o_orderstatus = 'P'").select(F.lit("order").alias("kind"), "id").unionByName(events)


@query("select o_custkey as id from orders where o_orderstatus = 'P' union select user_id from events where event_type = 'error'")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, "o_orderstatus = 'P'").unionByName(table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("id"))).distinct()


@query("select o_custkey as id from orders where o_orderstatus = 'P' union all select o_custkey from orders where o_orderpriority = '5-LOW'")
def set_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, "o_orderstatus = 'P'").unionByName(_orders(spark, sf_dir, "o_orderpriority = '5-LOW'"))


@query("select o_custkey as id from orders where o_custkey not in (select user_id from events)")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates of the left side stay, unlike EXCEPT."""
    return _orders(spark, sf_dir, "true").join(table(spark, sf_dir, "events").select(F.col("user_id").alias("id")), "id", "left_anti")


@query("select p_partkey from part where lower(trim(p_brand)) || p_size not in (select lower(trim(p_brand)) || p_size from part where p_partkey % 2 = 0)")
def set_difference_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower(F.trim("p_brand")), "p_size").alias("k"))
    return p.join(p.where("p_partkey % 2 = 0").select("k"), "k", "left_anti").select("p_partkey")


@query("select distinct l_partkey, l_suppkey from lineitem")
def set_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey").distinct()


@query("select o_custkey, min(o_orderkey) as o_orderkey from orders group by o_custkey")
def set_uniq_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_per(table(spark, sf_dir, "orders", "o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")])


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def set_existing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey").join(_orders(spark, sf_dir, "true").withColumnRenamed("id", "c_custkey"), "c_custkey", "left_anti")


@query("""with h as (select doc_id, sha256(coalesce(text, '')) as content_hash from documents), f as (select content_hash, min(doc_id) as doc_id from h group by content_hash), s as (select content_hash from h where doc_id % 5 = 0)
select doc_id, content_hash, content_hash in (select content_hash from s) as stored from f""")
def set_first_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each content, and whether that content is stored already."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stored = docs.where("doc_id % 5 = 0").select(F.sha2("text", 256).alias("content_hash")).distinct().withColumn("stored", F.lit(True))
    first = first_by_hash(docs, "text", [F.col("doc_id")])
    return first.join(stored, "content_hash", "left").select("doc_id", "content_hash", F.coalesce("stored", F.lit(False)).alias("stored"))


@query("select l_partkey, l_suppkey, arg_max(l_quantity, l_orderkey * 1000.0 + l_linenumber * 100 + l_quantity) as last_quantity from lineitem group by l_partkey, l_suppkey")
def set_last_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("position", F.struct("l_orderkey", "l_linenumber", "l_quantity"))
    return last_by_key(li, ["l_partkey", "l_suppkey"], "position").select("l_partkey", "l_suppkey", F.col("l_quantity").alias("last_quantity"))
