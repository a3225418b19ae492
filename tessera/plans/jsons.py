"""Array, map and JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import documents, jsons
from tessera.plans.filters import ELEMENTS, ITEMS, items
from tessera.registry import query
from tessera.tables import table

ROWS = "array<struct<q:int,flag:string>>"
IS_ARRAY = "json_type(body) = 'ARRAY'"


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where(F.col("body").startswith("[")).select("id", F.from_json("body", ROWS).alias("rows"))


@query("select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events")
def js_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


@query(f"with {ITEMS} select id, case when {IS_ARRAY} then json_array_length(body) else 0 end as n from items".replace("json_array_length(body)", "cast(json_array_length(body) as integer)"))
def js_typeof_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", F.size(jsons.array_or_empty(F.col("body"), "struct<q:int,flag:string>")).alias("n"))


@query(f"with {ITEMS} select id, cast(json_array_length(body) as integer) as n from items where {IS_ARRAY}")
def js_array_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where(F.col("body").startswith("[")).select("id", F.json_array_length("body").alias("n"))


@query(f"with {ITEMS} select id, len(list_filter({ELEMENTS}, lambda x: x.q > 45)) = 0 as clean from items where {IS_ARRAY}")
def js_not_exists_elem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays(spark, sf_dir).select("id", jsons.none_violates(F.col("rows"), lambda x: x["q"] > 45).alias("clean"))


@query(f"with {ITEMS} select id, len(list_filter({ELEMENTS}, lambda x: x.q < 3 and x.flag = 'N')) > 0 as found from items where {IS_ARRAY}")
def js_exists_elem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays(spark, sf_dir).select("id", jsons.any_matches(F.col("rows"), lambda x: (x["q"] < 3) & (x["flag"] == "N")).alias("found"))


@query("select o_orderkey, '{\"status\":\"' || o_orderstatus || '\"}' as body from orders")
def js_remove_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.create_map(F.lit("status"), "o_orderstatus", F.lit("old"), "o_orderpriority", F.lit("id"), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(jsons.without(entries, ["old", "id"])).alias("body"))


@query("select o_orderkey, '{\"a\":{\"status\":\"set\",\"n\":' || o_orderkey || '}}' as body from orders")
def js_set_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("n")).alias("a"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(doc.withField("a.status", F.lit("set"))).alias("body"))


@query("""select l_orderkey, l_linenumber, l_partkey, case when l_linenumber = 7 then null else '{"a":[1,' || l_linenumber || '],"b":"new","c":[0]}' end as body from lineitem""")
def js_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch of an array element and a field; a patch outside the allowed paths is refused."""
    path = F.when(F.col("l_linenumber") == 7, "/c/0").otherwise("/a/1")
    patch = F.format_string('[{"op":"replace","path":"%s","value":%d},{"op":"add","path":"/b","value":"new"}]', path, "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", documents.patched(F.lit('{"b":"old","a":[1,2],"c":[0]}'), patch, ("/a", "/b")).alias("body"))


@query("select a.o_orderkey, a.o_orderstatus is distinct from b.o_orderstatus or a.o_custkey is distinct from b.o_custkey as changed from orders a left join orders b on b.o_orderkey = a.o_orderkey - 1")
def js_diff_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the compared subset of a record differs from the version before."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.struct("o_orderstatus", "o_custkey").alias("now"))
    before = o.select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.col("now").alias("then"))
    joined = o.join(before, "o_orderkey", "left")
    changed = ~(F.col("now.o_orderstatus").eqNullSafe(F.col("then.o_orderstatus")) & F.col("now.o_custkey").eqNullSafe(F.col("then.o_custkey")))
    return joined.select("o_orderkey", changed.alias("changed"))


@query("select event_id, coalesce(json_extract_string(props, '$.name'), json_extract_string(props, '$.k')) as v from events")
def js_doc_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", jsons.first_path(F.col("props"), ["$.name", "$.info.k", "$.k"]).alias("v"))


@query("select n_nationkey, concat_ws(',', nullif(n_name, 'FRANCE'), case when n_regionkey > 2 then 'x' end) as v from nation")
def arr_filter_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(F.nullif("n_name", F.lit("FRANCE")), F.when(F.col("n_regionkey") > 2, "x"), F.lit(""))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(jsons.compact(values), ",").alias("v"))


@query("select p_partkey, list_has_all(string_split(p_type, ' '), ['STEEL']) as v from part")
def arr_every_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", jsons.covers(F.split("p_type", " "), F.array(F.lit("STEEL"))).alias("v"))


@query("select n_nationkey, case when n_name = 'CHINA' then 'CHINA,x' else 'CHINA,x,' || n_name end as v from nation")
def arr_union_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = jsons.union_ordered(F.array(F.lit("CHINA"), F.lit("x")), F.array(F.lit("x"), F.col("n_name")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(both, ",").alias("v"))


@query("select p_partkey, case when p_size % 4 = 0 then 'name' else 'name,size' end as keys from part")
def map_pick_truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.create_map(F.lit("name"), "p_name", F.lit("size"), (F.col("p_size") % 4).cast("string"), F.lit("off"), F.lit("false"), F.lit("empty"), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.map_keys(jsons.truthy(entries))), ",").alias("keys"))


@query(f"with {ITEMS}, f as (select id, unnest({ELEMENTS}) as x from items where {IS_ARRAY}) select id, x.q as q, x.flag as flag, id % 10 as shared from f")
def row_subform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sub-table as records with the scalars of their parent."""
    return arrays(spark, sf_dir).select("id", F.inline("rows"), (F.col("id") % 10).alias("shared"))
