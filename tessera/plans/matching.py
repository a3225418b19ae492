"""Matching, scoring and decisions.

The dictionary is made of parts: a term type is a brand, a term a part, its names the canonical texts; raw fields are lines of orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import concepts, dictionary, normalize, predicates, residues, rules, scoring
from tessera.operators.latest import top_per
from tessera.plans.joins import DEPTS, departments
from tessera.registry import query
from tessera.session import written
from tessera.tables import table

NORM = "regexp_replace(lower(trim({})), '[\\s()\\[\\]_:;,-]+', '', 'g')"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("term_id"), F.col("p_brand").alias("term_type"), F.col("p_name").alias("canonical"), F.col("p_type").alias("display"), "p_size")


EXPLICIT = "x as (select p_brand as term_type, p_type as alias, p_partkey as term_id from part where p_partkey % 5 = 0)"
ALIASES = f"""{EXPLICIT}, u as (select term_type, {NORM.format('alias')} as alias, term_id, 0 as tier from x
union all select p_brand, {NORM.format('p_name')}, p_partkey, 1 from part union all select p_brand, {NORM.format('p_type')}, p_partkey, 2 from part),
al as (select term_type, alias, term_id from (select *, row_number() over (partition by term_type, alias order by tier, term_id) as r from u) where r = 1)"""


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    return dictionary.aliases_by_precedence(p.where("term_id % 5 = 0").select("term_type", F.col("display").alias("alias"), "term_id"), p)


@query(f"with {ALIASES} select term_type, alias, term_id from al")
def dict_alias_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aliases(spark, sf_dir)


FIELDS = """f as (select l_orderkey * 10 + l_linenumber as field_id, p.p_brand as term_type, case l_linenumber % 4 when 0 then 'number' else 'enum' end as value_kind,
case l_linenumber % 3 when 0 then upper(p.p_name) when 1 then p.p_type || ' ' else 'other ' || l_suppkey end as value, l_partkey, l_suppkey from lineitem join part p on l_partkey = p_partkey)"""


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    k = F.col("l_linenumber")
    value = F.when(k % 3 == 0, F.upper("p_name")).when(k % 3 == 1, F.concat("p_type", F.lit(" "))).otherwise(F.concat(F.lit("other "), F.col("l_suppkey").cast("string")))
    joined = li.join(p, li.l_partkey == p.p_partkey)
    return joined.select((F.col("l_orderkey") * 10 + k).alias("field_id"), F.col("p_brand").alias("term_type"), F.when(k % 4 == 0, "number").otherwise("enum").alias("value_kind"), value.alias("value"), "l_partkey", "l_suppkey")


@query(f"with {ALIASES}, {FIELDS} select field_id, l_partkey, l_suppkey, case when value_kind = 'number' then null else al.term_id end as term_id, case when value_kind = 'number' then 'kind' when al.term_id is not null then 'alias' else 'none' end as how from f left join al on al.term_type = f.term_type and al.alias = {NORM.format('f.value')}")
def match_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.match_values(fields(spark, sf_dir), aliases(spark, sf_dir)).select("field_id", "l_partkey", "l_suppkey", "term_id", "how")


@query("""with n as (select distinct lower(p_type) as alias, p_brand as term_type, p_size % 3 as g from part), f as (select p_partkey as field_id, lower(p_type) as alias, p_size % 3 as g from part),
h as (select field_id, term_type, n.g = f.g as applies from f join n on regexp_replace(n.alias, '[\\s()_-]+', '', 'g') = regexp_replace(f.alias, '[\\s()_-]+', '', 'g')), s as (select field_id, bool_or(applies) as any_fits from h group by field_id)
select h.field_id, term_type, applies from h join s on h.field_id = s.field_id where applies or not any_fits""")
def match_term_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.text import normalize

    p = table(spark, sf_dir, "part")
    names = p.select(normalize(F.col("p_type")).alias("alias"), F.col("p_brand").alias("term_type"), (F.col("p_size") % 3).alias("g")).distinct()
    f = p.select(F.col("p_partkey").alias("field_id"), F.col("p_type").alias("name"), (F.col("p_size") % 3).alias("own"))
    return dictionary.match_term_types(f, names, F.col("g") == F.col("own"))


@query("""with h as (select a.p_partkey as field_id, b.p_partkey as term_id, case when a.p_brand = b.p_brand then 0.95 else 0.78 end as confidence, b.p_size as specificity from part a join part b on a.p_name = b.p_name)
select field_id, term_id from (select *, row_number() over (partition by field_id order by confidence desc, specificity desc, term_id) as r from h) where r = 1""")
def match_value_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("field_id"), F.col("p_name").alias("value"), F.col("p_brand").alias("term_type"))
    b = p.select(F.col("p_partkey").alias("term_id"), F.col("p_name").alias("value"), F.col("p_brand").alias("term_type"), F.col("p_size").alias("specificity"))
    return dictionary.match_any_type(a, b)


@query("""with a as (select lower(word) as alias, min(p_partkey) as term_id from (select p_partkey, unnest(string_split(p_type, ' ')) as word from part where p_partkey % 7 = 0) group by 1),
w as (select p_partkey as field_id, unnest(string_split(lower(p_type), ' ')) as alias, unnest(range(0, len(string_split(p_type, ' ')))) as i from part),
d as (select field_id, alias, min(i) as i from w group by 1, 2), j as (select d.*, a.term_id from d left join a using (alias)),
m as (select field_id, term_id, min(i) as i from j where term_id is not null group by 1, 2)
select j.field_id, coalesce((select string_agg(cast(term_id as varchar), ',' order by i) from m where m.field_id = j.field_id), '') as matched, coalesce(string_agg(alias, ',' order by i) filter (where term_id is null), '') as unmatched from j group by j.field_id""")
def match_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    words = p.where("p_partkey % 7 = 0").select(F.explode(F.split(F.lower("p_type"), " ")).alias("alias"), "p_partkey").groupBy("alias").agg(F.min("p_partkey").alias("term_id")).withColumn("term_type", F.lit("t"))
    found = dictionary.match_parts(p.select(F.col("p_partkey").alias("field_id"), F.lit("t").alias("term_type"), F.col("p_type").alias("value")), words)
    return found.select("field_id", F.array_join(F.col("matched").cast("array<string>"), ",").alias("matched"), F.array_join("unmatched", ",").alias("unmatched"))


DICTIONARY_SQL = """ta as (select distinct lower(p_type) as alias, p_brand as term_type from part), va as (select p_brand as term_type, lower(p_type) as alias, max(p_partkey) as term_id, max(p_size) / 100.0::double as confidence, max(p_size) as usage from part group by 1, 2),
tm as (select p_brand as term_type, replace(p_name, ' ', '') as canonical, min(p_partkey) as term_id from part group by 1, 2 union all select p_brand, lower(p_type), max(p_partkey) from part group by 1, 2)"""


def dictionary_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Types of parts as names of brands, and as aliases of the last part of their brand; names and types of parts as canonical texts."""
    p = table(spark, sf_dir, "part")
    by_type = p.groupBy(F.col("p_brand").alias("term_type"), F.col("p_type").alias("alias")).agg(F.max("p_partkey").alias("term_id"), (F.max("p_size") / F.lit(100.0)).alias("confidence"), F.max("p_size").alias("usage"))
    by_name = p.groupBy(F.col("p_brand").alias("term_type"), F.col("p_name").alias("canonical")).agg(F.min("p_partkey").alias("term_id"))
    return {
        "term_aliases": p.select(F.col("p_type").alias("alias"), F.col("p_brand").alias("term_type")).distinct(),
        "term_types": p.select(F.lower("p_brand").alias("term_type")).distinct(),
        "value_aliases": by_type,
        "terms": by_name.unionByName(by_type.select("term_type", F.col("alias").alias("canonical"), "term_id")),
    }


@query(f"""with {DICTIONARY_SQL}, c as (select p_partkey as id, case when p_partkey % 6 < 2 then 'term_type' else 'value' end as kind, p_brand as term_type, case p_partkey % 6 when 0 then lower(p_type) when 1 then lower(p_brand) when 2 then lower(p_type) when 3 then replace(p_name, ' ', '') else lower(p_type) || 'kit' end as key from part),
h as (select id, va.term_id, confidence from c join va on kind = 'value' and c.term_type = va.term_type and key = alias), n as (select c.* from c where kind = 'value' and id not in (select id from h)),
k as (select id, va.term_id, row_number() over (partition by id order by length(alias) desc, usage desc, va.term_id) as r from n join va on n.term_type = va.term_type and contains(key, alias) and key <> alias and length(alias) >= 2)
select id, 'term_type' as target_type, ta.term_type as target, 'exact_alias' as relation, 0.95::double as score from c join ta on kind = 'term_type' and key = ta.alias
union all select id, 'term_type', key, 'exact_alias', 0.98::double from c where kind = 'term_type' and id % 6 = 1
union all select id, 'term', cast(term_id as varchar), 'exact_alias', confidence from h
union all select c.id, 'term', cast(tm.term_id as varchar), 'exact_alias', 0.98::double from c join tm on kind = 'value' and c.term_type = tm.term_type and key = canonical
union all select id, 'term', cast(term_id as varchar), 'split_component', 0.78::double from k where r <= 5""")
def match_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate targets of several tiers, each with its score."""
    k = F.col("p_partkey") % 6
    value = F.when(k == 0, F.col("p_type")).when(k == 1, F.lower("p_brand")).when(k == 2, F.upper("p_type")).when(k == 3, F.col("p_name")).otherwise(F.concat("p_type", F.lit(" kit")))
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(k < 2, "term_type").otherwise("value").alias("kind"), F.col("p_brand").alias("term_type"), value.alias("value"))
    return concepts.targets(c, **dictionary_tables(spark, sf_dir))


@query(f"""with {DICTIONARY_SQL}, o as (select alias as key, term_type from va union select canonical, term_type from tm), g as (select key, array_to_string(list_sort(list(distinct term_type)), ',') as types from o group by key)
select l_orderkey, l_linenumber, l_partkey, types from lineitem join part on l_partkey = p_partkey left join g on key = case l_linenumber % 3 when 0 then lower(p_type) when 1 then replace(p_name, ' ', '') else p_name || '?' end""")
def match_known_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All term types that a value exists under, as an alias or as a canonical text."""
    d, k = dictionary_tables(spark, sf_dir), F.col("l_linenumber") % 3
    li, p = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey"), table(spark, sf_dir, "part")
    c = li.join(p, li.l_partkey == p.p_partkey).withColumn("value", F.when(k == 0, F.upper("p_type")).when(k == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit("?"))))
    return concepts.known_types(c, d["value_aliases"], d["terms"]).select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("known_types", ",").alias("types"))


TYPES = [("steel", "metal"), ("polished steel", "fine"), ("brass", "alloy"), ("tin", "soft")]
TYPES_SQL = ", ".join(f"('{a}', '{t}')" for a, t in TYPES)


@query(f"""with ty(alias, product_type) as (values {TYPES_SQL}), i as (select p_partkey as item_id, case when p_size % 5 = 0 then 'brass' else p_brand end as hint, p_type as name from part),
n as (select item_id, arg_max(product_type, length(alias)) as by_name from i join ty on contains(lower(name), alias) group by item_id)
select i.item_id, coalesce(h.product_type, by_name, 'unknown') as product_type, h.product_type is null and by_name is null as warned from i left join ty h on h.alias = i.hint left join n on n.item_id = i.item_id""")
def route_product_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_size") % 5 == 0, "brass").otherwise(F.col("p_brand")).alias("hint"), F.col("p_type").alias("name"))
    return dictionary.route_by_hint(p, spark.createDataFrame(TYPES, "alias string, product_type string"))


@query("""with t as (select l_orderkey, l_returnflag, min(l_linenumber) as target from lineitem group by 1, 2)
select l.l_orderkey, l.l_partkey, l.l_suppkey, case when l.l_linestatus = 'O' and t.target is not null then t.target else l.l_linenumber end as item from lineitem l left join t on t.l_orderkey = l.l_orderkey and t.l_returnflag = 'R'""")
def redirect_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of one kind move to the item of the same document that they belong to."""
    li = table(spark, sf_dir, "lineitem")
    target = li.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("target"))
    item = F.when((F.col("l_linestatus") == "O") & F.col("target").isNotNull(), F.col("target")).otherwise(F.col("l_linenumber"))
    return li.join(target, "l_orderkey", "left").select("l_orderkey", "l_partkey", "l_suppkey", item.alias("item"))


@query("""with l as (select l_orderkey, l_linenumber as pos, case when l_returnflag = 'R' then l_linestatus end as layer, l_partkey from lineitem)
select l_orderkey, min(pos) as pos, layer, count(*) as fields, sum(l_partkey) as keys from l where layer is not null group by l_orderkey, layer union all select l_orderkey, pos, null, 1, l_partkey from l where layer is null""".replace("sum(l_partkey)", "cast(sum(l_partkey) as bigint)"))
def group_layer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of one layer gather at the first one's place, others stay."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("layer"), "l_partkey")
    grouped = li.where("layer is not null").groupBy("l_orderkey", "layer").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("fields"), F.sum("l_partkey").alias("keys"))
    single = li.where("layer is null").select("l_orderkey", "layer", "pos", F.lit(1).cast("long").alias("fields"), F.col("l_partkey").alias("keys"))
    return grouped.unionByName(single)


@query("""select p_partkey, case p_partkey % 5 when 0 then '型号=SJ' || p_size || '；产量=' || (p_partkey % 90 + 10) || 'kg/h；原料=' || p_type when 1 then '产量=' || (p_partkey % 90 + 10) || '.5 公斤/小时以内；原料=' || p_type || '/PE' end as parts from part""")
def split_layer_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model, output and material of one text about a layer; kept with at least two of them."""
    size, amount = F.col("p_size").cast("string"), (F.col("p_partkey") % 90 + 10).cast("string")
    said = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    made = [said("A层 SJ", size, "挤出机 产量 ", amount, "kg/h 原料:", F.col("p_type")), said("第2层 产能", amount, ".5 公斤/小时以内，材料：", F.col("p_type"), "/PE"), said("SJ", size, "挤出机 ", amount, "kg/h"), said("B 层 ", amount, "kg/h"), F.lit("")]
    given = F.element_at(F.array(*made), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", concepts.layer_parts(given).alias("parts"))


RESIDUES = [
    ("connector_type", "与换网器配套 的连接器", "suppress"), ("connector_type", "快速连接器", "candidate"), ("deckle_type", "单边挡 30 mm", "suppress"), ("deckle_type", "内堵边", "candidate"), ("flow_channel_type", "其他（特殊支管式）", "suppress"),
    ("flow_channel_type", "衣架式", "candidate"), ("application", "用于PE 模头", "suppress"), ("application", "steel 板材", "reroute"), ("application", "板材", "candidate"), ("color", "  ", "suppress"), ("color", "红", "candidate"), (None, "红", "candidate"),
]


MATERIAL_CODES, MATERIAL_BODIES, MATERIAL_NOTES = ("PP", "ABS", "", "x1"), ("板材", "改性", "滑石粉", "流延膜"), ("", "（兼顾x）", "温度")


@query(f"""with p as (select p_partkey, {list(MATERIAL_CODES)}[p_partkey % 4 + 1] as code, {list(MATERIAL_BODIES)}[p_partkey // 4 % 4 + 1] as body, {list(MATERIAL_NOTES)}[p_partkey // 16 % 3 + 1] as note, {[r[2] for r in RESIDUES]}[p_partkey % {len(RESIDUES)} + 1] as fate from part),
m as (select *, body in ('板材', '流延膜') as product, case when code in ('PP', 'ABS') then body else code || body end as application from p)
select p_partkey, fate, case when product then 'reroute' when note = '温度' or (body = '滑石粉' and note = '') then 'suppress' else 'candidate' end as material_fate,
 case when not product then '' when note = '' and code <> '' then 'plastic_material=' || code || ',application=' || body when note = '' then 'application=' || body else 'application=' || application end as targets from m""")
def classify_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of a piece of a value that matched nothing, by the type of its term, and where materials and applications go."""
    k = F.col("p_partkey")
    rows = F.array(*[F.struct(F.lit(t).cast("string").alias("t"), F.lit(v).alias("v")) for t, v, _ in RESIDUES])
    r = F.element_at(rows, (k % len(RESIDUES) + 1).cast("int"))
    of = lambda given, i: F.element_at(F.array(*map(F.lit, given)), (i + 1).cast("int"))
    piece = F.concat(of(MATERIAL_CODES, k % 4), of(MATERIAL_BODIES, F.floor(k / 4) % 4), of(MATERIAL_NOTES, F.floor(k / 16) % 3))
    found = table(spark, sf_dir, "part").select("p_partkey", residues.fate(r["t"], r["v"], prefixes=("steel", "pe")).alias("fate"), residues.fates(F.lit("plastic_material"), piece).alias("m"))
    targets = F.array_join(F.transform("m.targets", lambda x: F.concat_ws("=", x["term_type"], x["value"])), ",")
    return found.select("p_partkey", "fate", F.col("m.action").alias("material_fate"), targets.alias("targets"))


@query("select p_brand, chunk, count(*) as n, min(p_partkey) as first_id from (select p_brand, p_partkey, (row_number() over (partition by p_brand order by p_partkey) - 1) // 6 as chunk from part) group by p_brand, chunk")
def batch_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.paging import chunks

    return chunks(table(spark, sf_dir, "part", "p_brand", "p_partkey"), ["p_brand"], [F.col("p_partkey")], 6).groupBy("p_brand", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_id"))


@query("""select l_orderkey, 'zone' || l_returnflag as base, array_to_string(list_sort(list(distinct l_linenumber)), ',') as indexes from lineitem group by all""")
def instance_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a number at their end, grouped by base within an item."""
    from tessera.functions.numbers import index_suffix

    named = table(spark, sf_dir, "lineitem").select("l_orderkey", index_suffix(F.concat_ws(" ", F.lit("zone"), "l_returnflag", F.col("l_linenumber").cast("string"))).alias("p"))
    return named.groupBy("l_orderkey", F.col("p.base").alias("base")).agg(F.array_join(F.array_sort(F.collect_set("p.number")).cast("array<string>"), ",").alias("indexes"))


@query(f"""with {EXPLICIT}, ex as (select term_type, {NORM.format('alias')} as alias, min(term_id) as term_id from x group by 1, 2),
s as (select p_brand as term_type, {NORM.format('p_name')} as alias, min(p_partkey) as term_id, count(distinct p_partkey) as owners from part group by 1, 2)
select term_type, alias, term_id from ex union all select s.term_type, s.alias, s.term_id from s where owners = 1 and not exists (select 1 from ex where ex.term_type = s.term_type and ex.alias = s.alias)""")
def dict_self_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term's own name becomes an alias, unless several terms claim it or it is one already."""
    from tessera.functions.text import normalize
    from tessera.operators.dml import insert_ignore

    p = parts(spark, sf_dir)
    existing = p.where("term_id % 5 = 0").groupBy("term_type", normalize(F.col("display")).alias("alias")).agg(F.min("term_id").alias("term_id"))
    own = p.groupBy("term_type", normalize(F.col("canonical")).alias("alias")).agg(F.min("term_id").alias("term_id"), F.count_distinct("term_id").alias("owners"))
    return insert_ignore(existing, own.where("owners = 1").drop("owners"), ["term_type", "alias"])


CANDIDATES = """old as (select p_type as key, max(p_size) / 100.0 as confidence, count(*) as n, case when min(p_size) % 2 = 0 then 'unknown' else 'old' end as source from part where p_partkey % 2 = 0 group by p_type),
fresh as (select p_type as key, p_size / 90.0 as confidence, 1 as n, case when p_size % 3 = 0 then 'unknown' else 'new' end as source from part where p_partkey % 2 = 1), rejected as (select distinct p_type as key from part where p_size = 7)"""


@query(f"""with {CANDIDATES}, g as (select key, max(confidence) as confidence, sum(n) as n, min(nullif(source, 'unknown')) as source from fresh where key not in (select key from rejected) group by key)
select key, greatest(o.confidence, g.confidence) as confidence, cast(coalesce(o.n, 0) + coalesce(g.n, 0) as bigint) as n, coalesce(nullif(o.source, 'unknown'), g.source, 'unknown') as source from old o full join g using (key)""")
def cand_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    old = p.where("p_partkey % 2 = 0").groupBy(F.col("p_type").alias("key")).agg((F.max("p_size") / F.lit(100.0)).alias("confidence"), F.count(F.lit(1)).alias("n"), F.when(F.min("p_size") % 2 == 0, "unknown").otherwise("old").alias("source"))
    new = p.where("p_partkey % 2 = 1").select(F.col("p_type").alias("key"), (F.col("p_size") / F.lit(90.0)).alias("confidence"), F.lit(1).alias("n"), F.when(F.col("p_size") % 3 == 0, "unknown").otherwise("new").alias("source"))
    return dictionary.upsert_candidates(old, new, ["key"], p.where("p_size = 7").select(F.col("p_type").alias("key")))


@query("select c_custkey, coalesce((select string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) from orders where o_custkey = c_custkey and o_orderstatus = 'P'), 'own:' || c_custkey) as docs from customer")
def cand_affected_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a candidate's occurrences, else its own."""
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("docs"))
    return table(spark, sf_dir, "customer", "c_custkey").join(seen, "c_custkey", "left").select("c_custkey", F.coalesce("docs", F.concat(F.lit("own:"), F.col("c_custkey").cast("string"))).alias("docs"))


@query("""select p_partkey, count(distinct l_orderkey) as docs, arg_max(l_orderkey, l_orderkey * 10 + l_linenumber) as latest, max(l_linenumber) as item from part left join lineitem on l_partkey = p_partkey group by p_partkey""")
def cand_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_orderkey").alias("docs"), F.max("l_orderkey").alias("latest"), F.max("l_linenumber").alias("item"))
    return table(spark, sf_dir, "part", "p_partkey").join(seen, "p_partkey", "left").select("p_partkey", F.coalesce("docs", F.lit(0)).cast("long").alias("docs"), "latest", "item")


@query("""with latest as (select o_custkey, max(o_orderkey) as o_orderkey from orders group by o_custkey) select p_partkey, coalesce(bool_or(l.l_orderkey in (select o_orderkey from latest)), false) as referenced from part left join lineitem l on l_partkey = p_partkey group by p_partkey""")
def cand_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a candidate still occurs in the latest extraction of some document."""
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("l_orderkey")).select("l_orderkey")
    used = table(spark, sf_dir, "lineitem").join(latest, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("referenced", F.lit(True))
    return table(spark, sf_dir, "part", "p_partkey").join(used, "p_partkey", "left").select("p_partkey", F.coalesce("referenced", F.lit(False)).alias("referenced"))


@query("""with k as (select o_orderkey, o_custkey as value, 0 as i from orders union all select o_orderkey, o_custkey % 10, 1 from orders), h as (select k.o_orderkey, s.c_custkey as split, row_number() over (partition by k.o_orderkey order by i) as r from k join customer s on s.c_custkey = k.value and s.c_custkey % 3 = 0) select o_orderkey, split from h where r = 1""")
def split_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision by the occurrence's value, else by the candidate's."""
    keys = F.posexplode(F.array("o_custkey", F.col("o_custkey") % 10)).alias("i", "value")
    splits = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("value"))
    hits = table(spark, sf_dir, "orders").select("o_orderkey", keys).join(splits, "value")
    return top_per(hits, ["o_orderkey"], [F.col("i")]).select("o_orderkey", F.col("value").alias("split"))


FIELD_NAMES = ("模唇厚度", "合同号", "备注", "上限温度", "第2套模头", "接单人", "A层", "螺杆")
FIELD_VALUES = ("PE/PP", "未选", "100kg/h", "12 mm", "a_b", "N/A", "3号", "钢", "推、拉", "客户提供", "x和y")


@query(f"""with p as (select p_partkey as id, p_partkey % 3 <> 0 as is_value, p_partkey % {len(FIELD_NAMES)} as f, case when p_partkey % 17 <> 0 then p_partkey // 8 % {len(FIELD_VALUES)} end as v, case when p_partkey % 5 = 0 then 'lip_adjustment_method' else p_brand end as term_type,
 p_partkey % 7 = 0 as is_document, p_partkey % 13 = 0 as indexed, p_partkey % 19 = 0 as structured from part),
k as (select distinct p_size % {len(FIELD_VALUES)} as v, p_brand as term_type from part), kf as (select distinct p_size % {len(FIELD_NAMES)} as f, p_brand as term_type from part where p_type = 'SMALL'),
d as (select id, 0.86 as c, 0 as i, 'ValueAsType' as n from p where not is_value and f in (select f from kf)
union all select id, case when structured then 0.68 else 0.82 end, 1, 'QualifierVariant' from p where structured or f in (3, 4, 6)
union all select id, 0.88, 2, 'PlaceholderValueNoise' from p where is_value and v in (1, 5)
union all select id, 0.78, 3, 'CompositeValue' from p where is_value and (v in (0, 2, 5, 10) or (v = 8 and term_type <> 'lip_adjustment_method'))
union all select id, 0.82, 4, 'ScopeContamination' from p where not is_document and (f in (1, 5) or v = 9)
union all select id, 0.83, 5, 'CrossTermTypeValue' from p where is_value and exists (select 1 from k where k.v = p.v and k.term_type <> p.term_type)
union all select id, case when indexed then 0.9 else 0.76 end, 6, 'MultiItemSignal' from p where indexed or f = 4 or v = 6
union all select id, 0.8, 7, 'NonConfigNoise' from p where f = 2 or (f in (6, 7) and v is null))
select id as p_partkey, string_agg(n, ',' order by c desc, i) as issues from d group by id""")
def issue_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    of = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i + 1).cast("int"))
    value = F.when(k % 17 != 0, of(FIELD_VALUES, F.floor(k / 8) % len(FIELD_VALUES)))
    c = p.select(
        k.alias("id"), F.when(k % 3 == 0, "term_type").otherwise("value").alias("kind"), of(FIELD_NAMES, k % len(FIELD_NAMES)).alias("field"), value.alias("value"), F.when(k % 5 == 0, "lip_adjustment_method").otherwise(F.col("p_brand")).alias("term_type"),
        F.when(k % 7 == 0, "document").alias("scope"), (k % 13 == 0).alias("indexed"), (k % 19 == 0).alias("has_qualifier"), F.lit(None).cast("string").alias("source_value"), F.lit(None).cast("string").alias("split_from"),
    )
    known = p.select(F.col("p_brand").alias("term_type"), of(FIELD_VALUES, F.col("p_size") % len(FIELD_VALUES)).alias("alias")).distinct()
    names = p.where("p_type = 'SMALL'").select(F.col("p_brand").alias("term_type"), of(FIELD_NAMES, F.col("p_size") % len(FIELD_NAMES)).alias("canonical")).distinct()
    c = concepts.known_types(c.withColumn("looked_up", F.when(F.col("kind") == "value", F.col("value")).otherwise(F.col("field"))), known, names, value="looked_up")
    said = F.array_join(F.transform(concepts.issues(), lambda x: x["detector"]), ",")
    return c.select(F.col("id").alias("p_partkey"), said.alias("issues")).where("issues <> ''")


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with evidence, made of the lines of orders."""
    c = F.col
    li = table(spark, sf_dir, "lineitem")
    k, q = c("l_partkey"), c("l_quantity").cast("int")
    relation = F.when(k % 5 == 0, "exact_alias").when(k % 5 == 1, "synonym_alias").when(k % 5 == 2, "split_component").when(k % 5 == 3, "qualifier_variant").otherwise("extraction_error")
    issues = F.when(q % 4 == 0, F.array(F.struct(F.when(q % 3 == 0, "high").otherwise("low").alias("risk"), (q % 3 == 0).alias("blocks")))).otherwise(F.array().cast("array<struct<risk:string,blocks:boolean>>"))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", c("l_discount").cast("decimal(18,6)").alias("disc"),
        (F.lit("0.9").cast("decimal(18,6)") - c("l_discount").cast("decimal(18,6)")).alias("base_score"),
        F.element_at(F.array(F.lit("trusted"), F.lit("provisional"), F.lit("suspect"), F.lit("deprecated")), (q % 4 + 1)).alias("trust_tier"),
        F.when(q % 3 == 0, q).alias("audit_risk"), (q % 9 == 0).alias("audit_blocks"), (k % 2 == 0).alias("alias_exact"), (q / 50).alias("synonym"), (q % 6).alias("usage"), (q % 5).alias("reviews"), (q % 2).alias("signals"),
        (q % 17 == 0).alias("unit_conflict"), (q % 19 == 0).alias("value_kind_conflict"), (q % 23 == 0).alias("product_type_mismatch"), (q % 11 == 0).alias("co_occurrence_conflict"), (q % 8).alias("together"),
        relation.alias("relation"), (q % 10).alias("occurrences"), issues.alias("issues"),
    )


CONTEXT_SQL = """c as (select l_orderkey, l_linenumber, l_partkey, l_partkey as k, cast(l_quantity as integer) as q, cast(l_discount as decimal(18,6)) as disc from lineitem),
v as (select *, 0.9 - disc as base, case q % 4 when 0 then 0.08 when 1 then -0.02 when 2 then -0.16 else -0.32 end as prior,
 case when k % 5 in (2, 3) then 1 else 0 end + case when q % 9 = 0 then 1 else 0 end + case when q % 17 = 0 then 1 else 0 end + case when q % 19 = 0 then 1 else 0 end + case when q % 23 = 0 then 1 else 0 end + case when q % 12 = 0 then 1 else 0 end as blocks from c),
s as (select *, least(1, greatest(0, base + prior + case when k % 2 = 0 then 0.05 else 0 end + case when q / 50.0 >= 0.8 then 0.03 else 0 end + least(0.06, (q % 5) * 0.02))) as trust,
 least(1, greatest(0, 0.8 + least(0.04, (q % 6) * 0.01) + least(0.03, (q % 2) * 0.01) + least(0.08, (q % 10) * 0.01))) as context,
 least(1, greatest(0, 1 - blocks * 0.35)) as constr,
 case when q % 3 = 0 then least(0.45, cast(q as decimal(18,6)) / 180) else 0 end + case when q % 17 = 0 then 0.28 else 0 end + case when q % 19 = 0 then 0.32 else 0 end + case when q % 23 = 0 then 0.2 else 0 end + case when q % 11 = 0 then 0.16 else 0 end
  + case when q % 8 > 4 then 0.05 else 0 end + case when q % 4 = 0 then case when q % 3 = 0 then 0.35 else 0.08 end else 0 end + case when k % 5 = 2 then 0.18 else 0 end as risk from v),
r as (select *, round(trust, 3) as t3, round(context, 3) as c3, round(constr, 3) as k3, round(least(1, greatest(0, risk)), 3) as r3 from s)"""
UNIFIED = "round(least(1, greatest(0, cast(t3 as decimal(18,6)) * 0.55 + cast(c3 as decimal(18,6)) * 0.25 + cast(k3 as decimal(18,6)) * 0.2 - cast(r3 as decimal(18,6)) * 0.45)), 3)"


@query(f"with {CONTEXT_SQL} select l_orderkey, l_linenumber, l_partkey, cast(t3 as double) as trust, cast(c3 as double) as context, cast(k3 as double) as constr, cast(cast(r3 as decimal(18,3)) as double) as risk, blocks > 0 as blocks, cast(cast({UNIFIED} as decimal(18,3)) as double) as unified from r")
def policy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.policy_score(contexts(spark, sf_dir))
    d = lambda c: F.col(c).cast("double")
    return s.select("l_orderkey", "l_linenumber", "l_partkey", d("trust_score").alias("trust"), d("context_score").alias("context"), d("constraint_score").alias("constr"), d("risk_score").alias("risk"), "blocks", d("unified_score").alias("unified"))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.policy_score(contexts(spark, sf_dir))
    q = F.col("together")
    flags = s.withColumns(
        {
            "kind": F.when(q % 2 == 0, "value").otherwise("term_type"), "action": F.when(F.col("relation") == "exact_alias", F.when(q % 2 == 0, "add_alias").otherwise("map_to_existing_termtype")).otherwise("add_alias"),
            "risk": F.when(F.col("product_type_mismatch") | F.col("value_kind_conflict") | F.col("unit_conflict"), "high").otherwise("low"), "issue_count": F.size("issues"), "passes": q == 6, "structured": q == 3, "llm": F.lit(True),
        }
    )
    return flags.withColumn("route", scoring.route())


ROUTE_SQL = f"""u as (select *, {UNIFIED} as un, q % 8 as g, case k % 5 when 0 then 'exact_alias' when 1 then 'synonym_alias' when 2 then 'split_component' when 3 then 'qualifier_variant' else 'extraction_error' end as rel, case when q % 17 = 0 or q % 19 = 0 or q % 23 = 0 then 'high' else 'low' end as rk, case when q % 4 = 0 then 1 else 0 end as ni from r),
w as (select *, case when rel = 'extraction_error' then 'auto_reject_pending' when g = 6 and rk = 'low' then 'auto_pass' when q % 10 < 2 and k % 2 <> 0 and ni = 0 then 'defer_until_more_occurrences' when rel = 'split_component' then 'human_review'
 when g % 2 = 0 and rel = 'exact_alias' and rk = 'low' and blocks = 0 then 'auto_accept_pending' when g % 2 = 1 and rel = 'exact_alias' and ni = 0 and un >= 0.92 and blocks = 0 then 'auto_pass' when rel = 'qualifier_variant' and rk = 'low' and g = 3 then 'auto_pass'
 when g % 2 = 1 and un >= 0.92 then 'human_review' when un >= 0.92 and blocks > 0 then 'human_review' when g % 2 = 0 and rel in ('exact_alias', 'synonym_alias') and un >= 0.92 and blocks = 0 then 'auto_accept_pending' when un >= 0.55 and ni = 0 then 'llm_review' else 'human_review' end as chosen from u)"""


@query(f"with {CONTEXT_SQL}, {ROUTE_SQL} select l_orderkey, l_linenumber, l_partkey, case when chosen = 'auto_accept_pending' and (g % 2 = 1 or rel = 'qualifier_variant' or blocks > 0) then 'human_review' else chosen end as route from w")
def route_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "route")


@query("select l_orderkey, l_partkey, l_linenumber, cast(row_number() over (partition by l_orderkey order by l_discount desc, l_quantity desc, l_partkey, l_linenumber) as integer) as place from lineitem")
def target_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("l_discount").desc(), F.col("l_quantity").desc(), F.col("l_partkey"), F.col("l_linenumber")]
    return top_per(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order, n=2**31 - 1, rank="place").select("l_orderkey", "l_partkey", "l_linenumber", "place")


@query("""with t as (select a.l_partkey, count(*) as together from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey <> b.l_partkey group by 1), s as (select l_partkey, count(distinct l_orderkey) as used, count(*) filter (where l_returnflag = 'A') as reviewed from lineitem group by 1)
select p_partkey, coalesce(together, 0) as together, coalesce(used, 0) as used, coalesce(reviewed, 0) as reviewed from part left join t on t.l_partkey = p_partkey left join s on s.l_partkey = p_partkey""")
def feat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by grouping: lines with another part in the same order, without a self join."""
    li = table(spark, sf_dir, "lineitem")
    same = li.groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    size = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("all"))
    together = same.join(size, "l_orderkey").groupBy("l_partkey").agg(F.sum(F.col("n") * (F.col("all") - F.col("n"))).alias("together"))
    used = li.groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("used"), F.count_if(F.col("l_returnflag") == "A").alias("reviewed"))
    counts = together.join(used, "l_partkey", "full")
    p = table(spark, sf_dir, "part", "p_partkey")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return p.join(counts, p.p_partkey == counts.l_partkey, "left").select("p_partkey", zero("together"), zero("used"), zero("reviewed"))


@query("""with b as (select p_brand as t, count(*) as n, cast(regexp_extract(p_brand, '[0-9]+') as bigint) as k, count(distinct p_type) as types from part group by 1),
t as (select *, case when k % 3 = 0 then 'number_unit' else 'enum' end as kind, case when k % 2 = 0 then 'document' else 'product' end as scope, case k % 4 when 0 then t || ' 合同' when 1 then t || ' 左侧' else t end as display, case when k % 5 = 0 then 'common' else 'O' end as product from b),
o as (select p_brand as t, case when l_returnflag = 'R' then 'enum' when p_size % 2 = 0 then 'enum' else 'number_unit' end as kind, l_linestatus as product, case when cast(regexp_extract(p_brand, '[0-9]+') as bigint) % 4 = 3 then 4 else l_linenumber % 5 end as v, l_suppkey from lineitem join part on l_partkey = p_partkey),
g as (select t, count(*) as affected, count(distinct kind) as kinds, min(kind) as one_kind, bool_or(product = 'F') as strange, count(*) filter (where v in (0, 3)) as measured, count(distinct case v when 0 then 'kg' when 3 then 'kg/h' end) as units, count(*) filter (where v = 2) as impure, count(*) filter (where v in (0, 1)) as several from o group by t),
c as (select p_brand as t, count(*) as clashes from part where p_type in (select p_type from part group by 1 having count(distinct p_brand) > 1) group by 1), u as (select p_brand as t, count(*) filter (where p_size > 49) as pending, count(*) filter (where p_size = 1 and p_type = 'SMALL') as high from part group by 1),
s as (select t.t, coalesce(affected, 0) as affected, t.k % 7 <> 0 as active, case when kinds > 1 or one_kind <> t.kind then 7 else 0 end as d1, case when coalesce(measured, 0) = 0 then 0 when t.kind = 'number_unit' then least(10, (units - 1) * 3) else least(10, 5 + units) end as d2, case when t.kind = 'enum' then least(10, coalesce(impure, 0) * 2) else 0 end as d3,
 least(10, coalesce(clashes, 0) * 3) as d4, case when scope <> 'document' and t.k % 4 = 0 then 8 else 0 end as d5, case when high > 0 then 6 else 0 end as d6, case when t.k % 4 = 1 then 5 else 0 end as d7, coalesce((several * 2000 + affected) // (2 * affected), 0) as d8, least(10, pending * 2) as d9, case when strange and t.product <> 'common' then 2 else 0 end as d10
 from t left join g using (t) left join c using (t) left join u using (t))
select t as term_type, least(10000, 100 * (d1 + d2 + d3 + d4 + d5 + d6 + d7 + d9 + d10) + d8) / 100.0::double as risk, concat_ws(',', case when d1 > 0 then 'value_kind_consistency' end, case when d2 > 0 then 'unit_consistency' end, case when d3 > 0 then 'enum_purity' end, case when d4 > 0 then 'alias_purity' end, case when d5 > 0 then 'scope_consistency' end,
 case when d6 > 0 then 'co_occurrence_conflict' end, case when d7 > 0 then 'qualifier_risk' end, case when d8 > 0 then 'composite_value_rate' end, case when d9 > 0 then 'candidate_mapping_pressure' end, case when d10 > 0 then 'product_type_spread' end) as labels,
 case when not active and affected > 0 then 'review_inactive_target_usage' when d4 > 0 then 'clean_alias_collision' when d1 > 0 then 'fix_value_kind' when d8 > 0 then 'split_composite_value' when d5 > 0 then 'move_scope' when d10 > 0 then 'limit_product_types' when d1 + d2 + d3 + d6 + d7 + d9 >= 40 then 'review_dictionary_target' else 'keep_observing' end as action, affected from s""")
def audit_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as term types, lines of orders as fields that were observed."""
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    number = lambda c: F.regexp_extract(c, "[0-9]+", 0).cast("long")
    k = number(F.col("term_type"))
    display = F.when(k % 4 == 0, F.concat("term_type", F.lit(" 合同"))).when(k % 4 == 1, F.concat("term_type", F.lit(" 左侧"))).otherwise(F.col("term_type"))
    types = p.select(F.col("p_brand").alias("term_type")).distinct().select(
        "term_type", display.alias("display"), F.when(k % 3 == 0, "number_unit").otherwise("enum").alias("value_kind"), F.when(k % 2 == 0, "document").otherwise("product").alias("scope"), (k % 7 != 0).alias("active"), F.array(F.when(k % 5 == 0, "common").otherwise("O")).alias("products")
    )
    v = F.when(number(F.col("p_brand")) % 4 == 3, 4).otherwise(F.col("l_linenumber") % 5)
    value = F.when(v == 0, F.concat(F.col("l_suppkey").cast("string"), F.lit(" kg"))).when(v == 1, "a/b").when(v == 2, "是").when(v == 3, "10 kg/h").otherwise("plain")
    kind = F.when((F.col("l_returnflag") == "R") | (F.col("p_size") % 2 == 0), "enum").otherwise("number_unit")
    observed = li.join(p, li.l_partkey == p.p_partkey).select(F.col("p_brand").alias("term_type"), kind.alias("value_kind"), value.alias("value"), F.col("l_linestatus").alias("product"))
    aliases = p.select(F.col("p_brand").alias("term_type"), F.col("p_type").alias("alias"))
    pressure = p.groupBy(F.col("p_brand").alias("term_type")).agg(F.count_if(F.col("p_size") > 49).alias("pending"), F.count_if((F.col("p_size") == 1) & (F.col("p_type") == "SMALL")).alias("high_risk"))
    h = concepts.health(types, observed, aliases, pressure)
    return h.select("term_type", F.col("risk").cast("double").alias("risk"), F.array_join("labels", ",").alias("labels"), "action", "affected")


@query("""with k as (select distinct p_brand, replace(p_name, ' ', '') as key from part where p_name <> 'red bolt'), s as (select key, list_sort(list(p_brand)) as brands from k group by key having count(*) > 1)
select 'cross_term' as finding, p_brand as term_type, k.key, array_to_string(list_filter(brands, lambda x: x <> p_brand), ',') as detail from k join s on s.key = k.key
union all select 'missing_metadata', p_brand, cast(p_partkey as varchar), concat_ws(',', case when p_size % 5 = 0 then 'scope' end, case when p_size % 7 = 0 then 'concept_role' end, case when p_type = 'SMALL' then 'risk_level' end) from part where p_size % 5 = 0 or p_size % 7 = 0 or p_type = 'SMALL'""")
def audit_cross_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that stand under other term types too, generic ones aside, and entries that lack what a decision needs."""
    p = table(spark, sf_dir, "part")
    across = concepts.cross_terms(p.select(F.col("p_brand").alias("term_type"), F.col("p_name").alias("value")), ["redbolt"])
    entries = p.select("p_partkey", "p_brand", F.when(F.col("p_size") % 5 != 0, "product").alias("scope"), F.when(F.col("p_size") % 7 == 0, " ").otherwise("value").alias("concept_role"), F.when(F.col("p_type") != "SMALL", "low").alias("risk_level"))
    lacking = concepts.missing_metadata(entries, ["scope", "concept_role", "risk_level"])
    found = across.select(F.lit("cross_term").alias("finding"), "term_type", "key", F.array_join("others", ",").alias("detail"))
    return found.unionByName(lacking.select(F.lit("missing_metadata").alias("finding"), F.col("p_brand").alias("term_type"), F.col("p_partkey").cast("string").alias("key"), F.array_join("missing", ",").alias("detail")))


DUPS = """d as (select doc_id, lang || '/' || source || '/' || (doc_id % 40) as name, sha256(text) as h, cast(case when n_chars > 2000 then 0 when n_chars > 500 then 1 else 3 end as integer) as rank from documents),
bh as (select name, h, count(*) as n, arg_min(doc_id, rank * 10000000 + doc_id) as canonical from d group by name, h), bn as (select name, sum(n) as n, count(h) as contents, bool_or(h is null) as missing from bh group by name having sum(n) > 1)"""


@query(f"""with {DUPS} select name, 'missing_blocks' as classification, null as content_hash, cast(null as bigint) as canonical, cast(n as bigint) as documents from bn where missing
union all select name, 'different_content', null, null, cast(n as bigint) from bn where not missing and contents > 1 union all select bh.name, 'same_content', h, canonical, cast(bh.n as bigint) from bh join bn on bn.name = bh.name and not missing where bh.n > 1""")
def dup_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one name (a language, a source and a number) by their whole contents."""
    d = table(spark, sf_dir, "documents")
    name = F.concat_ws("/", "lang", "source", (F.col("doc_id") % 40).cast("string"))
    rank = F.when(F.col("n_chars") > 2000, 0).when(F.col("n_chars") > 500, 1).otherwise(3)
    return dictionary.classify_duplicates(d.select("doc_id", name.alias("name"), F.col("text").alias("content"), rank.alias("rank")))


@query("""with d as (select doc_id, lang || '/' || source || '/' || (doc_id % 40) as name, sha256(text) as h from documents), n as (select name from d group by name having count(distinct h) > 1),
x as (select o_custkey as doc_id, o_orderkey, row_number() over (partition by o_custkey order by case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end, o_orderdate desc, o_orderkey desc) as r from orders)
select d.doc_id, d.name, d.h, l.quality as blocks, x.o_orderkey as latest from d join n on n.name = d.name left join labels l on l.doc_id = d.doc_id left join x on x.doc_id = d.doc_id and r = 1""")
def dup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose name has several contents, with their blocks (here labels) and their latest extraction (here orders), finished ones first."""
    name = F.concat_ws("/", "lang", "source", (F.col("doc_id") % 40).cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), F.sha2("text", 256).alias("h"))
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "doc_id")
    done = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    latest = top_per(o, ["doc_id"], [done, F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("doc_id", F.col("o_orderkey").alias("latest"))
    blocks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("blocks"))
    return dictionary.duplicate_names(d).join(blocks, "doc_id", "left").join(latest, "doc_id", "left").select("doc_id", "name", "h", "blocks", "latest")


@query("""with l as (select o_custkey, max(o_orderkey) as k from orders group by 1) select distinct o.o_custkey from l join orders o on o.o_orderkey = l.k where o.o_orderstatus <> 'P' and not exists (select 1 from lineitem where l_orderkey = o.o_orderkey and l_quantity > 45)""")
def dirty_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose latest extraction is stale and has no element that forbids a refresh."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderstatus")
    latest = top_per(o, ["o_custkey"], [F.col("o_orderkey").desc()]).where("o_orderstatus <> 'P'")
    bad = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return latest.join(bad, "o_orderkey", "left_anti").select("o_custkey").distinct()


@query("with l as (select o_custkey, max(o_orderkey) as o_orderkey from orders where o_orderstatus = 'F' group by 1) select * from l where o_orderkey not in (select l_orderkey from lineitem where l_linenumber = 1)")
def missing_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    stored = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return latest.join(stored, "o_orderkey", "left_anti").select("o_custkey", "o_orderkey")


@query("""with n as (select l_orderkey, count(*) as n, count(*) filter (where l_returnflag = 'R') as r from lineitem group by 1)
select o_orderkey, concat_ws(',', case when coalesce(n, 0) = 0 then 'no_items' end, case when o_orderstatus = 'P' then 'pending' end) as blockers, concat_ws(',', case when coalesce(r, 0) > 1 then 'returns' end, case when o_totalprice > 200000 then 'large' end) as warnings from orders left join n on l_orderkey = o_orderkey""")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    o = table(spark, sf_dir, "orders").join(n, "o_orderkey", "left")
    said = lambda *pairs: F.concat_ws(",", F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs])))
    blockers = said((F.coalesce("n", F.lit(0)) == 0, "no_items"), (F.col("o_orderstatus") == "P", "pending"))
    return o.select("o_orderkey", blockers.alias("blockers"), said((F.coalesce("r", F.lit(0)) > 1, "returns"), (F.col("o_totalprice") > 200000, "large")).alias("warnings"))


RULES = [
    {"ruleType": "price", "priority": 1, "addition": 10, "conditions": [{"field": "p_size", "operator": ">", "value": "20"}]},
    {"ruleType": "price", "priority": 2, "step": {"interval": 7, "amount": 100}, "conditions": [{"field": "p_brand", "operator": "=", "value": "Brand#1"}, {"field": "p_type", "operator": "contains", "value": "BRASS"}], "relation": "or"},
    {"ruleType": "price", "priority": 3, "addition": 5},
    {"ruleType": "price", "priority": 4, "addition": 1000, "active": False},
    {"ruleType": "grade", "priority": 1, "conditions": [{"field": "p_size", "operator": "<", "value": "10"}]},
    {"ruleType": "grade", "priority": 2, "grade": "B"},
    {"ruleType": "delivery", "priority": 1, "deliveryDays": 30, "conditions": [{"field": "p_type", "operator": "contains", "value": "STEEL"}]},
]


@query("""with a as (select p_partkey, p_size, p_brand, p_type, p_retailprice + case when p_size > 20 then 10 else 0 end as p from part), b as (select *, case when p_brand = 'Brand#1' or contains(p_type, 'BRASS') then ceil(p_size / 7.0) * 100 else p end as q from a)
select p_partkey, cast(q + 5 as double) as p_retailprice, case when p_size < 10 then null else 'B' end as grade, case when contains(p_type, 'STEEL') then 30 end as delivery_days from b""")
def rule_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "part"), RULES, "p_retailprice", "p_size").select("p_partkey", "p_retailprice", "grade", "delivery_days")


@query("select o_orderkey, 'notify' as action from orders where o_orderstatus = 'P' and o_totalprice >= 1000 union all select o_orderkey, 'archive' from orders where o_orderstatus = 'F'")
def trigger_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    triggers = [("notify", predicates.compiled([("o_orderstatus", "eq", "P"), ("o_totalprice", "range", [1000])])), ("archive", predicates.compiled([("o_orderstatus", "eq", "F")]))]
    return rules.triggered(table(spark, sf_dir, "orders"), triggers, "o_orderkey")


@query(f"""with recursive {DEPTS}, e as (select id, case when id = 4 then 19 else parent end as parent, name from d),
r as (select id, [name] as levels from e where parent is null union all select e.id, list_append(r.levels, e.name) from e join r on e.parent = r.id)
select e.id, levels[1] as l1, levels[2] as l2, levels[3] as l3, array_to_string(levels, '/') as path, cast(len(levels) as integer) as level, r.id is null as cyclic from e left join r on r.id = e.id""")
def hierarchy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from the root down; one department hangs below its own grandchild, with all that hangs below it."""
    d = departments(spark, sf_dir).withColumn("parent", F.when(F.col("id") == 4, F.lit(19)).otherwise(F.col("parent")))
    found = dictionary.hierarchy(d)
    return found.select("id", *[F.get("levels", i).alias(f"l{i + 1}") for i in range(3)], F.array_join("levels", "/").alias("path"), "level", "cyclic")


@query(f"with {DEPTS} select a.id, case when a.id % 5 = 0 then 'own' when b.id is not null and b.id % 2 = 1 then b.name when b.id is not null then coalesce(c.name, 'none') else 'none' end as leader from d a left join d b on a.parent = b.id left join d c on b.parent = c.id")
def leader_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The own leader, else the department's, else its parent's."""
    d = departments(spark, sf_dir)
    b, c = d.select(F.col("id").alias("parent"), F.col("name").alias("bn"), F.col("parent").alias("up")), d.select(F.col("id").alias("up"), F.col("name").alias("cn"))
    joined = d.join(b, "parent", "left").join(c, "up", "left")
    leader = F.when(F.col("id") % 5 == 0, "own").when(F.col("bn").isNotNull() & (F.col("parent") % 2 == 1), F.col("bn")).when(F.col("bn").isNotNull(), F.coalesce("cn", F.lit("none"))).otherwise("none")
    return joined.select("id", leader.alias("leader"))


PRODUCTS = [("small", "s"), ("economy", "e"), ("medium polished", "m"), ("um", "u")]


@query("""with f as (select l_orderkey as doc, l_linenumber as item, lower(p_type) as material, l_suppkey, p_size, case l_linenumber % 3 when 2 then null else replace(p_name, ' ', '') end as model from lineitem join part on l_partkey = p_partkey),
r as (select doc, item, min(case when contains(material, 'economy') then 'e' when contains(material, 'small') then 's' when contains(material, 'um') then 'u' else 'unknown' end) as product_type from f group by doc, item),
s as (select doc, min(item) as s_item from r where product_type = 's' group by doc),
g as (select doc, count(*) as items, array_to_string(list_sort(list(distinct product_type)), ',') as product_types from r group by doc),
w as (select f.*, product_type, product_type in ('e', 's') as by_number, product_type in ('u', 'unknown') as by_finish, case when product_type <> 's' and s_item is not null then s_item else f.item end as pump_item from f join r on r.doc = f.doc and r.item = f.item left join s on s.doc = f.doc)
select g.doc, items, items * 3 + count(distinct pump_item) + count(distinct case when by_number or product_type = 'unknown' then item end) + count(distinct case when by_finish then item end) as fields,
 count(distinct (item, model)) filter (where model is not null) + count(distinct (item, material)) + count(distinct (item, p_size)) filter (where by_finish and p_size % 2 = 0) as terms,
 count(distinct (item, l_suppkey)) + count(distinct (pump_item, l_suppkey)) + count(distinct (item, p_size)) filter (where by_number or product_type = 'unknown') as numbers,
 count(distinct l_suppkey) filter (where model is null) + count(distinct p_size) filter (where by_finish and p_size % 2 = 1) as value_candidates,
count(distinct l_suppkey % 7) as name_candidates, cast(g.doc as varchar) as info, product_types from g join w on w.doc = g.doc group by g.doc, items, product_types""")
def normalize_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as items with seven fields each.

    A numbered one, a measure, options, one of the document, an unknown one, one whose name two product types read differently, and one whose name
    points to another product type.
    """
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    lines = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("item"), "p_name", "p_type", F.col("p_size").cast("string").alias("size"), "l_suppkey")
    lines = written(lines, "lines")  # read for items, for fields and for their names
    supplier, k = F.col("l_suppkey").cast("string"), F.col("item") % 3
    model = F.when(k == 0, F.upper("p_name")).when(k == 1, F.col("p_name")).otherwise(F.concat(F.lit("other"), supplier))
    given = [
        (F.concat(F.lit("模头"), F.col("item").cast("string")), model), (F.lit("电压"), F.concat((F.col("l_suppkey") * 10).cast("string"), F.lit("V"))), (F.lit(" 材料 "), F.concat(F.lit("☑"), "p_type", F.lit(" □PP"))),
        (F.lit("合同号"), F.col("doc").cast("string")), (F.concat(F.lit("x"), (F.col("l_suppkey") % 7).cast("string"), F.lit("?")), F.lit("?")),
        (F.lit("规格"), F.concat("size", F.lit("mm"))), (F.lit("液压泵"), F.concat(supplier, F.lit("kW"))),
    ]
    fields = lines.select("doc", "item", F.explode(F.array(*[F.struct(n.alias("name"), v.alias("value")) for n, v in given])).alias("f")).select("doc", "item", "f.*")
    items = lines.select("doc", "item", F.lit(None).cast("string").alias("hint"), F.col("p_type").alias("name"))
    known = [("模头", "model", "enum", []), ("电压", "voltage", "number", []), ("材料", "material", "enum", ["common"]), ("规格", "width", "number", ["e", "s"]), ("规格", "finish", "enum", ["u"]), ("液压泵", "pump", "number", ["s"])]
    names = spark.createDataFrame(known, "alias string, term_type string, value_kind string, products array<string>")
    of = lambda term_type, alias: p.select(F.lit(term_type).alias("term_type"), alias.alias("alias"), F.col("p_partkey").alias("term_id"))
    aliases = of("model", F.col("p_name")).unionByName(of("material", F.col("p_type"))).unionByName(of("finish", F.concat(F.col("p_size").cast("string"), F.lit("MM"))).where("p_size % 2 = 0"))
    out = normalize.normalized(fields, items, spark.createDataFrame(PRODUCTS, "alias string, product_type string"), names, aliases, ("合同号",), spark.createDataFrame([("液压", "s")], "word string, product_type string"))
    return out.select("doc", "items", "fields", "terms", "numbers", "value_candidates", "name_candidates", "info", F.array_join("product_types", ",").alias("product_types"))
