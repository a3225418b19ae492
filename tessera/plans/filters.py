"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import jsons
from tessera.operators import predicates
from tessera.registry import query
from tessera.tables import table


@query("select p_partkey as id, p_name as name, p_retailprice as price from part")
def proj_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))


@query("select o_orderkey, cast(case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as integer) as status_rank from orders")
def proj_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf_dir, "orders").select("o_orderkey", rank.alias("status_rank"))


@query("select event_id, coalesce(nullif(json_extract_string(props, '$.name'), ''), nullif(event_type, 'view'), json_extract_string(props, '$.k')) as label from events")
def proj_coalesce_nullif(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, k = F.get_json_object("props", "$.name"), F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.nullif(name, F.lit("")), F.nullif("event_type", F.lit("view")), k).alias("label"))


@query("select 'customer' as kind, c_custkey as id from customer union all select 'supplier', s_suppkey from supplier")
def proj_literal_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = lambda name, key: table(spark, sf_dir, name).select(F.lit(name).alias("kind"), F.col(key).alias("id"))
    return tagged("customer", "c_custkey").unionByName(tagged("supplier", "s_suppkey"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as integer) as k, cast(event_id as varchar) as id_text, try_cast(event_type as bigint) as bad from events")
def proj_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.col("event_id").cast("string").alias("id_text"), F.col("event_type").try_cast("bigint").alias("bad"))


@query("select o_orderkey from orders where o_orderstatus = 'O' and o_orderpriority in ('1-URGENT', '2-HIGH')")
def filt_eq_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("select l_orderkey, l_linenumber from lineitem where l_quantity between 10 and 20 and l_shipdate between timestamp '1995-01-01' and timestamp '1995-12-31'")
def filt_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = F.col("l_shipdate").between(F.expr("timestamp_ntz '1995-01-01'"), F.expr("timestamp_ntz '1995-12-31'"))
    return table(spark, sf_dir, "lineitem").where(F.col("l_quantity").between(10, 20) & dates).select("l_orderkey", "l_linenumber")


@query("select p_partkey, p_name from part where p_name like '%1_0%'")
def filt_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern comes from a user: % and _ in it are wildcards on purpose."""
    return table(spark, sf_dir, "part", "p_partkey", "p_name").where(F.col("p_name").like("%1_0%"))


@query("select c_custkey, c_name from customer where c_name ilike '%cUSTOMER%9%'")
def filt_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey", "c_name").where(F.col("c_name").ilike("%cUSTOMER%9%"))


@query("select c_custkey from customer where starts_with(c_name, substr('Customer#000000012', 1, 15))")
def filt_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(F.col("c_name").startswith("Customer#000000012"[:15])).select("c_custkey")


@query("select p_partkey, p_type from part where regexp_matches(p_type, '(?i)steel|brass$') and regexp_matches(p_name, '[0-9]+')")
def filt_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_type").rlike("(?i)steel|brass$") & F.col("p_name").rlike("[0-9]+")).select("p_partkey", "p_type")


@query("select doc_id from documents where text is not null and lang is not null and source <> '' and n_chars is not null")
def filt_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null and lang is not null and source <> '' and n_chars is not null").select("doc_id")


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus = 'F'")
def filt_opt_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.given(table(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority=None).select("o_orderkey", "o_orderstatus")


@query("select a.event_id from events a where json_extract_string(props, '$.missing') is not distinct from nullif(event_type, event_type)")
def filt_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.get_json_object("props", "$.missing").eqNullSafe(F.nullif("event_type", F.col("event_type")))).select("event_id")


VISIBLE = "(c.c_nationkey = 3 or n.n_regionkey = 1 or o.o_orderpriority = '1-URGENT')"


@query(f"select o.o_orderkey from orders o join customer c on o_custkey = c_custkey join nation n on c_nationkey = n_nationkey where {VISIBLE} and o.o_orderstatus = 'O'")
def filt_or_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a reader may see through any of three relations; readers who see all are a parameter of the caller."""
    o, c, n = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    seen = (F.col("c_nationkey") == 3) | (F.col("n_regionkey") == 1) | (F.col("o_orderpriority") == "1-URGENT")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).where(seen).select("o_orderkey")


ITEMS = """items as (select l_orderkey as id, to_json(list({'q': cast(l_quantity as integer), 'flag': l_returnflag} order by l_linenumber, cast(l_quantity as integer), l_returnflag)) as body from lineitem where l_orderkey % 7 <> 0 group by l_orderkey
union all select o_orderkey, '{"q": 1}' from orders where o_orderkey % 7 = 0)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, body): the lines of an order as a JSON array, some orders as a JSON object."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", F.struct(F.col("l_quantity").cast("int").alias("q"), F.col("l_returnflag").alias("flag")).alias("x"))))
    body = F.to_json(F.transform(lines, lambda x: x["x"]))
    li = table(spark, sf_dir, "lineitem").where("l_orderkey % 7 <> 0").groupBy(F.col("l_orderkey").alias("id")).agg(body.alias("body"))
    return li.unionByName(table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id"), F.lit('{"q": 1}').alias("body")))


@query(f"with {ITEMS} select id from items where json_type(body) = 'ARRAY' and json_array_length(body) > 3")
def filt_json_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where(F.col("body").startswith("[") & (F.json_array_length("body") > 3)).select("id")


ELEMENTS = "from_json(body, '[{\"q\":\"INTEGER\",\"flag\":\"VARCHAR\"}]')"


@query(f"with {ITEMS} select id from items where json_type(body) = 'ARRAY' and len(list_filter({ELEMENTS}, lambda x: x.flag = 'R')) > 0")
def filt_json_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where(jsons.contains(F.col("body"), '[{"flag": "R"}]')).select("id")


@query(f"with {ITEMS} select id, json_type(body) = 'OBJECT' and json_exists(body, '$.q') as has_q from items")
def filt_json_haskey(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.coalesce(F.array_contains(F.json_object_keys(F.when(F.col("body").startswith("{"), F.col("body"))), "q"), F.lit(False))
    return items(spark, sf_dir).select("id", keys.alias("has_q"))


@query("""select o_orderkey from orders where o_orderstatus = 'O' and o_orderpriority <> '5-LOW' and contains(o_orderpriority, 'M') and o_totalprice >= 1000 and o_totalprice <= 200000""")
def filt_dynamic_dsl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("o_orderstatus", "eq", "O"), ("o_orderpriority", "ne", "5-LOW"), ("o_orderpriority", "like", "M"), ("o_totalprice", "range", [1000, 200000]), ("o_orderstatus", "not_empty"), ("o_custkey", "unknown_method", 1)]
    return table(spark, sf_dir, "orders").where(predicates.compiled(rules)).select("o_orderkey")


@query("""select o_orderkey from orders where o_orderstatus = '' or o_orderpriority in ('1-URGENT', '5-LOW') or o_orderpriority not in ('3-MEDIUM', '2-HIGH', '1-URGENT', '5-LOW') or o_totalprice >= 300000""")
def filt_remote_dsl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("o_orderstatus", "empty"), ("o_orderpriority", "in", ["1-URGENT", "5-LOW"]), ("o_orderpriority", "nin", ["3-MEDIUM", "2-HIGH", "1-URGENT", "5-LOW"]), ("o_totalprice", "range", [300000])]
    return table(spark, sf_dir, "orders").where(predicates.compiled(rules, "or")).select("o_orderkey")


@query("select event_id from events where hour(ts) between 11 and 13")
def filt_time_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.hour("ts").between(11, 13)).select("event_id")


@query("select doc_id from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def filt_default_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 0).alias("fine"))
    return predicates.not_switched_off(table(spark, sf_dir, "documents", "doc_id"), flags, "doc_id", "fine")


@query("select 'hit' as asked, p_partkey from part where contains(p_name, '12') or not exists (select 1 from part where contains(p_name, '12')) union all select 'miss', p_partkey from part")
def filt_like_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name")
    found = [predicates.like_or_all(p, "p_name", part).select(F.lit(name).alias("asked"), "p_partkey") for name, part in (("hit", "12"), ("miss", "no such part"))]
    return found[0].unionByName(found[1])


@query("select o_orderkey from orders where 1 = 0")
def filt_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", "o_orderkey").where(F.lit(False))


@query("""select n_nationkey, (n_name in ('FRANCE', 'CHINA', 'Model') or n_regionkey = 3) and n_regionkey <> 4 as header from nation""")
def filt_header_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of texts: the name, and a header word or a text with a colon by region."""
    second = F.when(F.col("n_regionkey") == 3, "Model").when(F.col("n_regionkey") == 4, "size: 3").otherwise("x")
    return table(spark, sf_dir, "nation").select("n_nationkey", predicates.header_like(F.array("n_name", second), ["FRANCE", "CHINA", "Model"], ["kW"]).alias("header"))


@query("""with t as (select p_partkey, case p_partkey % 4 when 0 then [] when 1 then ['common'] when 2 then [p_brand] else ['Brand#99'] end as types, case when p_size % 5 = 0 then 'unknown' when p_size % 5 = 1 then null else p_brand end as wanted from part)
select p_partkey, wanted is null or wanted = 'unknown' or len(types) = 0 or list_contains(types, 'common') or coalesce(list_contains(types, wanted), false) as applies from t""")
def filt_applicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey") % 4, F.col("p_size") % 5
    types = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("common"))).when(k == 2, F.array("p_brand")).otherwise(F.array(F.lit("Brand#99")))
    wanted = F.when(s == 0, "unknown").when(s == 1, F.lit(None)).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", predicates.applicable(types, wanted).alias("applies"))
