"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aliases as alias_operators
from tessera.operators import ranges
from tessera.operators.latest import top_per
from tessera.registry import query
from tessera.tables import table


@query("select o_orderkey, l_linenumber, l_quantity from orders join lineitem on o_orderkey = l_orderkey where o_orderstatus = 'F'")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.where("o_orderstatus = 'F'").join(li, o.o_orderkey == li.l_orderkey).select("o_orderkey", "l_linenumber", "l_quantity")


@query("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer", "c_custkey"), table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey")


@query("select c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey and c_custkey % 10 = s_suppkey % 10")
def join_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 10).alias("corp"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), (F.col("s_suppkey") % 10).alias("corp"))
    return ranges.equal_pairs(c, s, ["n", "corp"], "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey")


DEPTS = "d as (select p_partkey as id, case when p_partkey > 4 then p_partkey // 4 end as parent, p_name as name from part)"


def departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent, name): parts as a tree of four children each."""
    parent = F.when(F.col("p_partkey") > 4, F.expr("p_partkey div 4"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), parent.alias("parent"), F.col("p_name").alias("name"))


@query(f"with {DEPTS} select a.id, b.name as dept, c.name as parent_dept from d a left join d b on a.parent = b.id left join d c on b.parent = c.id")
def join_self_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = departments(spark, sf_dir)
    a, b, c = d.alias("a"), d.alias("b"), d.alias("c")
    return a.join(b, F.col("a.parent") == F.col("b.id"), "left").join(c, F.col("b.parent") == F.col("c.id"), "left").select("a.id", F.col("b.name").alias("dept"), F.col("c.name").alias("parent_dept"))


@query("select c_custkey from customer left join orders on c_custkey = o_custkey where o_orderkey is null")
def join_anti_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("select p_partkey from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R')")
def join_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return p.join(li, p.p_partkey == li.l_partkey, "left_anti").select("p_partkey")


@query("""select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')
or exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000) or exists (select 1 from supplier where s_nationkey = c_nationkey and s_acctbal < 0) or c_acctbal < -900""")
def join_exists_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disjunction of existence tests: one semi join for each table, on the union of the ids that qualify."""
    c, o, s = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    by_order = o.where("o_orderstatus = 'P' or o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    poor = s.where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    ids = by_order.unionByName(c.join(poor, "c_nationkey", "left_semi").select("c_custkey")).unionByName(c.where("c_acctbal < -900").select("c_custkey"))
    return c.join(ids, "c_custkey", "left_semi").select("c_custkey")


BEST = """best as (select *, row_number() over (partition by o_custkey order by case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end, o_orderdate desc, o_orderkey desc) as r from orders)"""


def best_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    return top_per(o, ["o_custkey"], [rank, F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()])


@query(f"with {BEST} select c_custkey, o_orderkey, o_orderstatus from customer left join best on c_custkey = o_custkey and r = 1")
def join_latest_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer", "c_custkey"), best_orders(spark, sf_dir)
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey", "o_orderstatus")


@query(f"with {BEST} select c_custkey, o_orderkey from customer join best on c_custkey = o_custkey and r = 1")
def join_latest_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer", "c_custkey"), best_orders(spark, sf_dir)
    return c.join(o, c.c_custkey == o.o_custkey).select("c_custkey", "o_orderkey")


@query("select doc_id, w.i as place, w.word from documents, lateral (select unnest(generate_series(1, len(string_split(text, chr(10))))) as i, unnest(string_split(text, chr(10))) as word) w")
def join_lateral_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "word")).select("doc_id", (F.col("i") + 1).cast("long").alias("place"), "word")


@query("""select p_partkey, s.size from part left join (select p_partkey as k, unnest(generate_series(1, p_size - 47)) as size from part) s on s.k = p_partkey""")
def join_lateral_unnest_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.when(F.col("p_size") > 47, F.sequence(F.lit(1).cast("long"), (F.col("p_size") - 47).cast("long")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode_outer(sizes).alias("size"))


@query("""select event_id, coalesce(c_name, s_name) as name from events left join customer on event_type in ('view', 'click') and user_id = c_custkey left join supplier on event_type = 'purchase' and user_id = s_suppkey""")
def join_polymorphic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c, s = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer", "c_custkey", "c_name"), table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    e = e.join(c, e.event_type.isin("view", "click") & (e.user_id == c.c_custkey), "left").join(s, (e.event_type == "purchase") & (e.user_id == s.s_suppkey), "left")
    return e.select("event_id", F.coalesce("c_name", "s_name").alias("name"))


@query("""select o_orderkey, m.level from orders join (values ('A', 3), ('B', 2), ('C', 1)) m(code, level) on m.code = case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'A' when o_orderpriority = '3-MEDIUM' then 'B' else 'C' end""")
def join_on_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "A").when(F.col("o_orderpriority") == "3-MEDIUM", "B").otherwise("C")
    levels = spark.createDataFrame([("A", 3), ("B", 2), ("C", 1)], "code string, level int")
    return table(spark, sf_dir, "orders").withColumn("code", code).join(levels, "code").select("o_orderkey", "level")


@query("select o_orderstatus, count(*) as n, (select count(*) from orders) as total from orders group by o_orderstatus")
def join_on_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals beside each row: one row, so the product is no larger than its left side."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(o.agg(F.count(F.lit(1)).alias("total"))))


@query("select a.p_partkey as a, b.p_partkey as b from part a join part b on lower(trim(a.p_name)) = lower(trim(b.p_name)) and a.p_partkey < b.p_partkey")
def join_exact_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.trim("p_name")).alias("alias"))
    return ranges.ordered_pairs(p, ["alias"], "p_partkey")


@query("select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey")
def join_hash_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "n_name")


@query("""select o_orderkey, (select min(l_linenumber) from lineitem where l_orderkey = o_orderkey and l_quantity > 30) as line from orders""")
def join_nested_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders", "o_orderkey"), table(spark, sf_dir, "lineitem")
    found = li.where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linenumber").alias("line"))
    return o.join(found, "o_orderkey", "left").select("o_orderkey", "line")


TRIPS = "t as (select o_orderkey as id, o_custkey as user_id, o_orderdate as start, o_orderdate + interval 7 day as \"end\" from orders)"


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, start, end): orders as trips of a week."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("start"), F.expr("o_orderdate + interval 7 days").alias("end"))


@query(f'with {TRIPS} select a.id, b.id as b_id from t a join t b on a.user_id = b.user_id and a.start <= b."end" and a."end" >= b.start and a.id < b.id')
def join_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trips(spark, sf_dir)
    return ranges.overlapping(t, t, "user_id", "start", "end").where("id < b_id").select("id", "b_id")


LEAVES = """leave as (select user_id, ts as start, ts + interval 2 hour as "end" from events where event_type = 'signup'),
outing as (select user_id, ts as start, ts + interval 4 hour as "end" from events where event_type = 'click'),
trip as (select user_id, ts as start, ts + interval 1 day as "end" from events where event_type = 'error'),
v as (select event_id, user_id, ts from events where event_type = 'view')"""


@query(f"""with {LEAVES}, h as (select event_id, 0 as tier, 'leave' as reason, start from v join leave i on v.user_id = i.user_id and ts between start and "end"
union all select event_id, 1, 'outing', start from v join outing i on v.user_id = i.user_id and ts between start and "end"
union all select event_id, 2, 'trip', start from v join trip i on v.user_id = i.user_id and ts between start and "end"),
b as (select event_id, reason, start, row_number() over (partition by event_id order by tier, start) as r from h)
select v.event_id, b.reason, b.start as since from v left join b on v.event_id = b.event_id and r = 1""")
def join_point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    tier = lambda kind, length: e.where(F.col("event_type") == kind).select("user_id", F.col("ts").alias("start"), F.expr(f"ts + interval {length}").alias("end"))
    points = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return ranges.first_interval(points, "user_id", "ts", "event_id", ("leave", tier("signup", "2 hours")), ("outing", tier("click", "4 hours")), ("trip", tier("error", "1 day"))).select("event_id", "reason", "since")


@query(f"""with {TRIPS}, d as (select distinct user_id, cast(unnest(generate_series(date_trunc('day', start), date_trunc('day', "end"), interval 1 day)) as date) as day from t)
select day, count(*) as users from d group by day""")
def join_interval_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.days_of(trips(spark, sf_dir), "start", "end").groupBy("day").agg(F.count_distinct("user_id").alias("users"))


@query("""with a as (select c_custkey, (c_custkey * 37 % 1000) / 1000.0 as x, (c_custkey * 91 % 1000) / 1000.0 as y from customer where c_custkey % 3 = 0),
b as (select c_custkey as place, (c_custkey * 37 % 1000) / 1000.0 as x, (c_custkey * 91 % 1000) / 1000.0 as y from customer where c_custkey % 3 <> 0),
h as (select c_custkey, place, row_number() over (partition by c_custkey order by (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), place) as r from a join b on abs(a.x - b.x) <= 0.0625 and abs(a.y - b.y) <= 0.0625)
select a.c_custkey, h.place as near_place from a left join h on a.c_custkey = h.c_custkey and r = 1""")
def join_band_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda f: (F.col("c_custkey") * f % 1000 / F.lit(1000.0))
    c = table(spark, sf_dir, "customer").select("c_custkey", at(37).alias("x"), at(91).alias("y"))
    places = c.where("c_custkey % 3 <> 0").withColumnRenamed("c_custkey", "place")
    return ranges.nearest_in_band(c.where("c_custkey % 3 = 0"), places, "c_custkey", "place", "x", "y", 0.0625).select("c_custkey", "near_place")


@query("select event_id, lag(event_id) over (partition by user_id order by ts, event_id) as previous from events")
def join_asof_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(w).alias("previous"))


@query("""with h as (select a.p_partkey as a, b.p_partkey as b, cast(greatest(length(a.p_name), length(b.p_name)) - levenshtein(a.p_name, b.p_name) as double) / greatest(length(a.p_name), length(b.p_name)) as score
from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey <> b.p_partkey),
r as (select *, row_number() over (partition by a order by score desc, b) as r from h where score >= 0.5) select a, b, score from r where r = 1""")
def join_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size")
    a, b, block = p.withColumnRenamed("p_partkey", "a"), p.withColumnRenamed("p_partkey", "b"), F.struct("p_brand", "p_size")
    return ranges.fuzzy(a, b, "a", "b", ("p_name", "p_name"), (block, block), 0.5, apart=True)


@query("""with i as (select p_partkey as item, p_brand as brand, p_type as type, cast(p_size as varchar) as size from part where p_partkey % 2 = 0),
m as (select p_partkey as master, p_brand as brand, p_type as type, case when p_partkey % 3 = 0 then '' else cast(p_size as varchar) end as size from part where p_partkey % 2 = 1),
v as (select item, master, cast(i.brand = m.brand as bigint) + cast(i.type = m.type as bigint) + cast(i.size = m.size and i.size <> '' as bigint) as votes, i.brand <> m.brand or i.type <> m.type or (i.size <> m.size and i.size <> '' and m.size <> '') as conflict from i, m)
select item, min(master) as master, min(votes) as votes from v where votes >= 2 and not conflict group by item having count(*) = 1""")
def join_attr_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size"))
    items = p.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "item")
    master = p.where("p_partkey % 2 = 1").withColumn("size", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("size"))).withColumnRenamed("p_partkey", "master")
    return ranges.attribute_vote(items, master, "item", "master", ["brand", "type", "size"])


@query("""with l as (select n_nationkey as l, case n_nationkey % 4 when 0 then n_name when 1 then ' ' || n_name when 2 then lower(n_name) else n_name || '-' end as name from nation),
h as (select l, n_nationkey as r, case when name = n_name then 0 when trim(name) = n_name then 1 when lower(trim(name)) = lower(n_name) then 2 else 3 end as tier from l join nation on regexp_replace(lower(name), '[ -]', '', 'g') = regexp_replace(lower(n_name), '[ -]', '', 'g'))
select l, arg_min(r, tier * 1000 + r) as r, cast(min(tier) as integer) as tier from h group by l""")
def join_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey") % 4
    name = F.when(k == 0, F.col("n_name")).when(k == 1, F.concat(F.lit(" "), "n_name")).when(k == 2, F.lower("n_name")).otherwise(F.concat("n_name", F.lit("-")))
    left, right = n.select(F.col("n_nationkey").alias("l"), name.alias("name")), n.select(F.col("n_nationkey").alias("r"), F.col("n_name").alias("other"))
    a, b = F.col("name"), F.col("other")
    plain = lambda c: F.regexp_replace(F.lower(c), "[ -]", "")
    return ranges.cascade(left, right, "l", "r", [(a, b), (F.trim(a), b), (F.lower(F.trim(a)), F.lower(b)), (plain(a), plain(b))])


@query("""with a as (select distinct n_regionkey as k, substr(n_name, 1, 3 + n_nationkey % 4) as alias, n_nationkey as usage from nation),
h as (select c_custkey, alias, row_number() over (partition by c_custkey order by length(alias) desc, usage desc) as rank from (select c_custkey, c_custkey % 5 as k, t.n_name || ' ' || u.n_name as text from customer join nation t on t.n_nationkey = c_nationkey join nation u on u.n_nationkey = (c_nationkey + 1) % 25) x join a on a.k = x.k and contains(text, alias))
select c_custkey, alias, cast(rank as integer) as rank from h where rank <= 5""")
def join_contains_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    aliases = n.select(F.col("n_regionkey").cast("long").alias("k"), F.expr("substr(n_name, 1, 3 + n_nationkey % 4)").alias("alias"), F.col("n_nationkey").alias("usage"))
    t, u = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"))
    texts = table(spark, sf_dir, "customer").join(t, F.col("i") == F.col("c_nationkey")).join(u, F.col("j") == (F.col("c_nationkey") + 1) % 25).select("c_custkey", (F.col("c_custkey") % 5).alias("k"), F.concat_ws(" ", "a", "b").alias("text"))
    return alias_operators.first_contained(texts, aliases, "c_custkey", "text", "k", "alias", [F.col("usage").desc()], 5).select("c_custkey", "alias", "rank")


@query("""select event_id, coalesce(c.c_name, s.s_name) as report from events left join customer c on event_type <> 'error' and c.c_custkey = user_id left join supplier s on event_type = 'error' and s.s_suppkey = user_id % 10""")
def join_two_keys_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c, s = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer", "c_custkey", "c_name"), table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    by_key = e.join(c, (e.event_type != "error") & (e.user_id == c.c_custkey), "left")
    return by_key.join(s, (F.col("event_type") == "error") & (F.col("user_id") % 10 == s.s_suppkey), "left").select("event_id", F.coalesce("c_name", "s_name").alias("report"))


QUALIFIED = "q as (select p_partkey, p_brand as term, case when p_size % 3 = 0 then null when p_size % 3 = 1 then '' else 'top' end as layer, p_size % 7 as value from part)"


@query(f"""with {QUALIFIED} select a.p_partkey, true as conflict from q a where exists (select 1 from q b where a.term = b.term and coalesce(a.layer, '') = coalesce(b.layer, '') and a.value <> b.value)
union all select a.p_partkey, false from q a where not exists (select 1 from q b where a.term = b.term and coalesce(a.layer, '') = coalesce(b.layer, '') and a.value <> b.value)""")
def join_conflict_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same key with null and empty alike, another value: one aggregation in place of a self join."""
    s = F.col("p_size") % 3
    layer = F.when(s == 0, F.lit(None)).when(s == 1, "").otherwise("top")
    q = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("term"), F.coalesce(layer, F.lit("")).alias("layer"), (F.col("p_size") % 7).alias("value"))
    spread = q.groupBy("term", "layer").agg((F.min("value") != F.max("value")).alias("conflict"))
    return q.join(spread, ["term", "layer"]).select("p_partkey", "conflict")


@query("select p_name, count(distinct p_brand) as brands from part group by p_name having count(distinct p_brand) > 1")
def join_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("brands")).where("brands > 1")


@query("""select l_orderkey, l_linenumber, p_name, s_name, o_orderdate from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey left join orders on o_orderkey = l_orderkey and o_orderstatus = 'F' where p_size = 10""")
def join_multi_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p, s, o = (table(spark, sf_dir, n) for n in ("lineitem", "part", "supplier", "orders"))
    joined = li.join(p.where("p_size = 10"), li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).join(o.where("o_orderstatus = 'F'"), li.l_orderkey == o.o_orderkey, "left")
    return joined.select("l_orderkey", "l_linenumber", "p_name", "s_name", "o_orderdate")


@query(f"""with {BEST} select c_custkey, b.o_orderkey, s_suppkey from customer left join best b on c_custkey = b.o_custkey and r = 1 left join supplier on s_nationkey = c_nationkey and s_suppkey = c_custkey where c_mktsegment in ('BUILDING', 'MACHINERY')""")
def join_contract_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, s = table(spark, sf_dir, "customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')"), best_orders(spark, sf_dir), table(spark, sf_dir, "supplier")
    return c.join(o, c.c_custkey == o.o_custkey, "left").join(s, (s.s_nationkey == c.c_nationkey) & (s.s_suppkey == c.c_custkey), "left").select("c_custkey", "o_orderkey", "s_suppkey")


@query("""with o as (select o_custkey, list(o_orderkey order by o_orderkey) as orders from orders group by o_custkey), e as (select user_id, list(event_id order by event_id) as events from events group by user_id)
select c_custkey, array_to_string(coalesce(orders, []), ',') as orders, array_to_string(coalesce(events, []), ',') as events from customer left join o on o_custkey = c_custkey left join e on user_id = c_custkey""")
def join_eager_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two child collections, each gathered before it is joined, so that they do not multiply."""
    c = table(spark, sf_dir, "customer", "c_custkey")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.array_sort(F.collect_list("event_id")).alias("events"))
    text = lambda name: F.array_join(F.coalesce(F.col(name).cast("array<string>"), F.array()), ",").alias(name)
    return c.join(o, "c_custkey", "left").join(e, "c_custkey", "left").select("c_custkey", text("orders"), text("events"))
