"""Windows and ordered scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import sessions
from tessera.operators.latest import top_per
from tessera.plans.filters import ELEMENTS, ITEMS, items
from tessera.plans.joins import BEST, best_orders
from tessera.registry import query
from tessera.tables import table


@query("""select o_orderkey from (select o_orderkey, row_number() over (partition by o_custkey, o_orderstatus, o_orderpriority order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1""")
def win_row_number_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return top_per(o, ["o_custkey", "o_orderstatus", "o_orderpriority"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()]).select("o_orderkey")


@query("select distinct on (user_id) user_id, event_id, event_type from events order by user_id, ts desc, event_id desc")
def win_distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_per(table(spark, sf_dir, "events", "user_id", "event_id", "event_type", "ts"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).drop("ts")


@query(f"with {BEST} select o_custkey, o_orderkey, o_orderstatus from best where r = 1")
def win_status_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""select event_id, case when lag(event_type) over w = event_type then null else (epoch_us(ts) - epoch_us(lag(ts) over w)) / 1000000.0 end as gap from events window w as (partition by user_id order by ts, event_id)""")
def win_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    return e.select("event_id", sessions.gap_seconds(e, ["user_id"], "ts", "event_type", "event_id").alias("gap"))


DEBOUNCED = """with recursive e as (select event_id, user_id, {kind} as kind, epoch_us(ts) as t, row_number() over (partition by user_id, {kind} order by ts, event_id) as n from events),
f as (select *, t as last, true as kept from e where n = 1 union all select e.*, case when e.t - f.last >= {us} then e.t else f.last end, e.t - f.last >= {us} from f join e on e.user_id = f.user_id and e.kind = f.kind and e.n = f.n + 1)
select event_id from f where kept"""


@query(DEBOUNCED.format(kind="event_type", us=86_400_000_000))
def win_gap_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops a repeat of the same kind within a day of the last one kept."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    return sessions.folded(e, "user_id", "ts", "event_type", ["event_id"], sessions.debounce(86_400, True), "keep").where("keep").select("event_id")


@query(DEBOUNCED.format(kind="0", us=43_200_000_000))
def win_dedup_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops any event of a user within half a day of the last one kept."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")
    return sessions.folded(e, "user_id", "ts", "event_type", ["event_id"], sessions.debounce(43_200, False), "keep").where("keep").select("event_id")


@query("""with e as (select event_id, user_id, event_type, epoch_us(ts) as t, lag(event_type) over w as before, lag(epoch_us(ts)) over w as since from events where event_type in ('click', 'view') window w as (partition by user_id order by ts, event_id))
select event_id, (t - since) as stay from e where event_type = 'view' and before = 'click'""")
def win_pair_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each exit (view) with the open entry (click) before it."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts").where("event_type in ('click', 'view')")
    pairs = sessions.folded(e, "user_id", "ts", "event_type", ["event_id"], sessions.paired("click", "view"), "entered", sessions.LONG)
    return pairs.where("entered is not null").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.col("entered")).alias("stay"))


@query("select event_id, count(*) over (partition by user_id, cast(ts as date) order by ts, event_id) as nth from events")
def win_count_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("nth"))


@query("""with h as (select distinct o_custkey, 2 * date_diff('day', date '1990-01-01', cast(o_orderdate as date)) + case when o_orderkey % 2 = 0 then 1 else 0 end as half from orders),
r as (select *, half - row_number() over (partition by o_custkey order by half) as run from h) select o_custkey, min(half) as first, max(half) as last, count(*) as length from r group by o_custkey, run""")
def win_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive half days become one range."""
    half = 2 * F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("long") + F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(0)
    return sessions.islands(table(spark, sf_dir, "orders").select("o_custkey", half.alias("half")), "o_custkey", "half")


@query("select l_orderkey, min(l_linenumber) = 1 and max(l_linenumber) = count(distinct l_linenumber) and count(distinct l_linenumber) >= 2 as whole from lineitem where l_quantity > 5 group by l_orderkey")
def win_contiguous_from_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_distinct("l_linenumber")
    whole = (F.min("l_linenumber") == 1) & (F.max("l_linenumber") == n) & (n >= 2)
    return table(spark, sf_dir, "lineitem").where("l_quantity > 5").groupBy("l_orderkey").agg(whole.alias("whole"))


@query("""select user_id, min(ts) filter (where event_type = 'click' and ts > timestamp '2024-01-15') as next_entry, max(ts) filter (where event_type = 'view' and ts < timestamp '2024-01-15') as last_exit from events group by user_id""")
def win_extreme_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestamp_ntz '2024-01-15'")
    after, before = (F.col("event_type") == "click") & (F.col("ts") > at), (F.col("event_type") == "view") & (F.col("ts") < at)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.when(after, F.col("ts"))).alias("next_entry"), F.max(F.when(before, F.col("ts"))).alias("last_exit"))


@query(f"with {ITEMS}, f as (select id, unnest({ELEMENTS}) as x, unnest(generate_series(1, len({ELEMENTS}))) as place from items where json_type(body) = 'ARRAY') select id, place, x.q as q from f")
def win_ordinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.posexplode(F.from_json("body", "array<struct<q:int,flag:string>>")).alias("i", "x")
    return items(spark, sf_dir).where(F.col("body").startswith("[")).select("id", rows).select("id", (F.col("i") + 1).cast("long").alias("place"), F.col("x.q").alias("q"))
