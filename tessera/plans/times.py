"""Date and time functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import times
from tessera.registry import query
from tessera.tables import table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts")


@query("""select event_id, date_trunc('day', ts) as day_start, date_trunc('day', ts) + interval 1 day - interval 1 millisecond as day_end, date_trunc('month', ts) as month_start,
date_trunc('month', ts) + interval 1 month - interval 1 millisecond as month_end, cast(date_trunc('week', ts) as timestamp) as week_start from events""")
def dt_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    named = {"day_start": times.day_start(t), "day_end": times.day_end(t), "month_start": F.date_trunc("month", t), "month_end": times.month_end(t), "week_start": times.week_start(t)}
    return events(spark, sf_dir).select("event_id", *[c.cast("timestamp_ntz").alias(n) for n, c in named.items()])


HALF = "case when hour(ts) < 12 then date_trunc('day', ts) else date_trunc('day', ts) + interval 12 hour end"


@query(f"select event_id, case when hour(ts) < 12 then 'AM' else 'PM' end as half, {HALF} as half_start, {HALF} + interval 12 hour - interval 1 millisecond as half_end from events")
def dt_half_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    return events(spark, sf_dir).select("event_id", times.half(t).alias("half"), times.half_start(t).cast("timestamp_ntz").alias("half_start"), times.half_end(t).cast("timestamp_ntz").alias("half_end"))


@query("""select event_id, date_trunc('day', ts) + case when hour(ts) < 12 then interval 0 hour else interval 12 hour end as begins, date_trunc('day', ts) + case when hour(ts) < 12 then interval 43199 second else interval 86340 second end as ends from events""")
def dt_half_day_asym(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, part = F.to_date("ts"), times.half(F.col("ts"))
    return events(spark, sf_dir).select("event_id", times.half_point(day, part, True).alias("begins"), times.half_point(day, part, False).alias("ends"))


@query(f"select event_id, {HALF} + interval 12 hour as next_start, {HALF} - interval 1 millisecond as previous_end from events")
def dt_half_day_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    return events(spark, sf_dir).select("event_id", times.next_half(t).cast("timestamp_ntz").alias("next_start"), times.previous_half_end(t).cast("timestamp_ntz").alias("previous_end"))


@query("select o_orderkey, cast(unnest(generate_series(date_trunc('day', o_orderdate), date_trunc('day', o_orderdate) + interval 3 day, interval 1 day)) as date) as day from orders")
def dt_days_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.explode(F.sequence(F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 3)))
    return table(spark, sf_dir, "orders").select("o_orderkey", days.alias("day"))


@query("""with r as (select o_orderkey, cast(epoch(o_orderdate) as bigint) as a, cast(epoch(o_orderdate) as bigint) + (o_orderkey % 100) * 86400 as b from orders),
s as (select o_orderkey, unnest(generate_series(a, greatest(a, b - 1), 29 * 86400)) as "from", b from r) select o_orderkey, "from", least("from" + 29 * 86400, b) as "to" from s""")
def dt_split_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 100 as int))")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(times.slices(F.col("o_orderdate"), end)).alias("s")).select("o_orderkey", "s.*")


@query("""with p as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 5 day)) as t), q as (select t as starts, lead(t) over (order by t) as ends from p)
select starts, ends, count(event_id) as n from q left join events on ts >= starts and ts < ends where ends is not null group by starts, ends""")
def dt_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in consecutive periods: the period is computed from the time, so there is no range join."""
    points = spark.range(1).select(F.explode(F.expr("sequence(timestamp_ntz '2024-01-01', timestamp_ntz '2024-01-31', interval 5 day)")).alias("starts"))
    periods = points.withColumn("ends", F.lead("starts").over(Window.orderBy("starts"))).where("ends is not null")
    started = F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(cast(floor(datediff(ts, date '2024-01-01') / 5) * 5 as int))")
    counts = events(spark, sf_dir).groupBy(started.alias("starts")).agg(F.count(F.lit(1)).alias("n"))
    return periods.join(counts, "starts", "left").select("starts", "ends", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("select o_orderkey, date_trunc('day', o_orderdate) + to_hours(o_orderkey % 40) + to_minutes(o_orderkey % 60) as at from orders")
def dt_over_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.concat_ws(":", (F.col("o_orderkey") % 40).cast("string"), (F.col("o_orderkey") % 60).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", times.over_24h(F.to_date("o_orderdate"), clock).alias("at"))


@query("select event_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) < 30600 as early, hour(ts) * 3600 + minute(ts) * 60 + second(ts) > 63000 as late from events")
def dt_clock_cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = times.seconds_of_day(F.col("ts"))
    return events(spark, sf_dir).select("event_id", (s < times.clock_seconds(F.lit("08:30"))).alias("early"), (s > times.clock_seconds(F.lit("17:30"))).alias("late"))


@query("""with e as (select event_id, hour(ts) * 3600 + minute(ts) * 60 + cast(second(ts) as integer) as s from events) select event_id, s > 30600 and s < 43200 as day, s > 79200 or s < 21600 as night from e""")
def dt_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts")
    return events(spark, sf_dir).select("event_id", times.within_clock(t, F.lit("08:30-12:00")).alias("day"), times.within_clock(t, F.lit("22:00-次日06:00")).alias("night"))


@query("""with e as (select event_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as before from events)
select event_id, (epoch_us(ts) - epoch_us(before)) // 60000000 as minutes, date_diff('day', before, ts) as days from e where before is not null""")
def dt_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = events(spark, sf_dir).withColumn("before", before).where("before is not null")
    return e.select("event_id", times.minutes_between(F.col("before"), F.col("ts")).alias("minutes"), F.datediff("ts", "before").cast("long").alias("days"))


@query("select l_orderkey, l_linenumber, l_quantity * case when l_returnflag = 'A' then 86400 else 3600 end as seconds from lineitem")
def dt_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("l_returnflag") == "A", "DAY").otherwise("HOUR")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", times.duration(F.col("l_quantity"), unit).alias("seconds"))


@query("""with o as (select o_orderkey, cast(o_orderdate as date) as a, cast(o_orderdate as date) + cast(o_orderkey % 5 as integer) as b, case o_orderkey % 3 when 0 then 'AM' when 1 then 'PM' end as x, case o_orderkey % 2 when 0 then 'AM' else 'PM' end as y from orders),
h as (select o_orderkey, 2 * date_diff('day', a, b) + case y when 'AM' then 0 else 1 end - case x when 'AM' then 0 when 'PM' then 1 end + 1 as h from o) select o_orderkey, case when h > 0 then h / 2.0 end as days from h""".replace("h / 2.0", "cast(h as double) / 2"))
def dt_leave_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, a = F.col("o_orderkey"), F.to_date("o_orderdate")
    x, y = F.when(k % 3 == 0, "AM").when(k % 3 == 1, "PM"), F.when(k % 2 == 0, "AM").otherwise("PM")
    return table(spark, sf_dir, "orders").select("o_orderkey", times.leave_days(a, x, F.date_add(a, (k % 5).cast("int")), y).alias("days"))


@query("select event_id, ['星期日', '星期一', '星期二', '星期三', '星期四', '星期五', '星期六'][dayofweek(ts) + 1] as name from events")
def dt_weekday_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", times.weekday_name(F.col("ts")).alias("name"))


@query("select o_orderkey, case when month(o_orderdate) between 6 and 9 then '13:30' else '13:00' end as lunch from orders")
def dt_summer_lunch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", times.lunch(F.col("o_orderdate")).alias("lunch"))


@query("select o_orderkey, make_timestamp((1700000000 + o_orderkey) * 1000000) as at from orders")
def dt_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.timestamp_seconds(F.col("o_orderkey") + 1_700_000_000).cast("timestamp_ntz").alias("at"))


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M') as at from events")
def dt_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"))


_CUT = """select id, case when ca <= a and cb > a then least(cb, b) else a end as a, case when ca < b and cb >= b and not (ca <= a and cb > a) then greatest(ca, a) else b end as b"""


@query(f"""with o as (select o_orderkey as id, o_orderkey % 20 as a, o_orderkey % 20 + 10 as b, o_orderkey % 31 as x, o_custkey % 37 as y from orders),
c as (select *, x < y or (x = y) as x_first from o), one as ({_CUT}, x, y, x_first from (select *, case when x_first then x else y end as ca, case when x_first then x + 3 else y + 5 end as cb from c)),
two as ({_CUT} from (select *, case when x_first then y else x end as ca, case when x_first then y + 5 else x + 3 end as cb from one)) select id, case when a < b then a end as start, case when a < b then b end as "end" from two""")
def dt_slot_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval cut by conflicts in order of their start."""
    k = F.col("o_orderkey")
    conflict = lambda c, n: F.struct(c.alias("start"), (c + n).alias("end"))
    slot = times.free_slot(k % 20, k % 20 + 10, F.array(conflict(k % 31, 3), conflict(F.col("o_custkey") % 37, 5)))
    return table(spark, sf_dir, "orders").select(k.alias("id"), slot.alias("s")).select("id", "s.start", "s.end")
