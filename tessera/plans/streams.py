"""Streaming twins of the event operators over the table of events as a stream of files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import sessions
from tessera.plans.windowed import DEBOUNCED
from tessera.registry import query
from tessera.session import shared_folder
from tessera.streaming import twins
from tessera.tables import table

MINI = "event_id, user_id, event_type, ts"


def _stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Callable[[], None]]]:
    """Events as a stream, and the steps that bring them: three ranges of time, those without a time in the first; each makes a micro-batch."""
    path = f"{shared_folder(spark).rstrip('/')}/events-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events", *MINI.split(", "))
    e.limit(0).write.parquet(path)
    ranges = ("ts is null or ts < '2024-01-11'", "ts >= '2024-01-11' and ts < '2024-01-21'", "ts >= '2024-01-21'")
    return twins.source(spark, path, e.schema), [lambda part=part: e.where(part).write.mode("append").parquet(path) for part in ranges]


@query(f"select {MINI} from events where event_type = 'purchase'")
def st_microbatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, feed = _stream(spark, sf_dir)
    return twins.run(stream.where("event_type = 'purchase'"), feed)


@query("select distinct user_id, event_type, cast(ts as date) as day from events")
def st_dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, feed = _stream(spark, sf_dir)
    days = stream.withColumn("day", F.to_date("ts"))
    return twins.run(twins.deduplicated(days, ["user_id", "event_type", "day"], "ts", "60 days").select("user_id", "event_type", "day"), feed)


@query(DEBOUNCED.format(kind="0", us=43_200_000_000))
def st_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream, feed = _stream(spark, sf_dir)
    kept = twins.folded(stream, "user_id", "ts", "event_type", ["event_id"], sessions.debounce(43_200, False), "keep")
    return twins.run(kept, feed).where("keep").select("event_id")


@query("""with e as (select event_id, user_id, event_type, epoch_us(ts) as t, lag(event_type) over w as before, lag(epoch_us(ts)) over w as since from events where event_type in ('click', 'view') window w as (partition by user_id order by ts, event_id))
select event_id, (t - since) as stay from e where event_type = 'view' and before = 'click'""")
def st_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exits with their entries, though the events come in batches that are not in order of time."""
    return _stays(spark, sf_dir, ["event_id % 3 = 1", "event_id % 3 = 0", "event_id % 3 = 2"]).select(F.col("exit").alias("event_id"), (F.unix_micros("left") - F.unix_micros("entered")).alias("stay"))


def _stays(spark: SparkSession, sf_dir: str, parts: list[str]) -> DataFrame:
    """Pairs of clicks and views of events that come in ``parts``; at last one event after all others lets the watermark pass them."""
    path = f"{shared_folder(spark).rstrip('/')}/events-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events", *MINI.split(", "))
    end = e.agg(F.max("event_id").alias("event_id"), F.lit(None).cast(e.schema["user_id"].dataType).alias("user_id"), F.lit("end").alias("event_type"), (F.max("ts") + F.expr("interval 61 days")).alias("ts"))
    e.limit(0).write.parquet(path)
    feed = [lambda df=df: df.write.mode("append").parquet(path) for df in [*(e.where(part) for part in parts), end]]
    stream = twins.source(spark, path, e.schema).where("event_type in ('click', 'view', 'end')")
    return twins.run(twins.stays(stream, "user_id", "ts", "event_type", "event_id", "click", "view", "60 days"), feed)


@query("""with m as (select unnest([15, 25, 30]) as minutes), x as (select user_id, ts, min(case when event_type = 'click' then ts end) over (partition by user_id order by ts range between interval 1 microsecond following and unbounded following) as back, event_type from events),
w as (select date_trunc('millisecond', max(ts)) - interval 1 day as closed from events where event_type in ('click', 'view'))
select user_id, cast(ts as timestamp) as "left", cast(minutes as integer) as minutes from x, m, w where event_type = 'view' and (back > ts + to_minutes(minutes) or (back is null and ts + to_minutes(minutes) < closed))""")
def st_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms for exits without a return, raised by timers once the watermark of one day has passed them."""
    stream, feed = _stream(spark, sf_dir)
    alarms = twins.overdue(stream.where("event_type in ('click', 'view')"), "user_id", "ts", "event_type", "view", "click", (15, 25, 30), "1 day")
    return twins.run(alarms, feed).withColumn("left", F.col("left").cast("timestamp_ntz"))


@query("""with e as (select ts, event_type, lag(event_type) over w as before, epoch_us(ts) - lag(epoch_us(ts)) over w as stay from events where event_type in ('click', 'view') window w as (partition by user_id order by ts, event_id)),
s as (select date_trunc('day', ts) as start, count(*) as stays, cast(sum(stay) as bigint) as micros from e where event_type = 'view' and before = 'click' group by 1),
d as (select date_trunc('day', ts) as start, event_type, count(*) as n from events where ts < (select date_trunc('day', max(ts) - interval 1 day) from events) group by 1, 2)
select start, event_type, n, coalesce(stays, 0) as stays, coalesce(micros, 0) as micros from d left join s using (start)""")
def st_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the days that the watermark of one day has closed, beside the stays that ended on them, whose records came late and twice."""
    stream, feed = _stream(spark, sf_dir)
    counts = twins.run(twins.counted(stream, ["event_type"], "ts", "1 day", "1 day"), feed).withColumn("start", F.col("start").cast("timestamp_ntz"))
    pairs = _stays(spark, sf_dir, ["ts >= '2024-01-16'", "event_id % 2 = 0", "ts < '2024-01-21'"])
    ended = pairs.groupBy(F.date_trunc("day", "left").cast("timestamp_ntz").alias("start")).agg(F.count(F.lit(1)).alias("stays"), F.sum(F.unix_micros("left") - F.unix_micros("entered")).alias("micros"))
    return counts.join(ended, "start", "left").na.fill(0, ["stays", "micros"])


@query("select count(*) as n, count(distinct event_id) as ids from events")
def st_skip_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of one query follow each other: every event is handled once."""
    path = f"{shared_folder(spark).rstrip('/')}/handled-{uuid.uuid4().hex}"
    stream, feed = _stream(spark, sf_dir)
    twins.in_batches(stream, lambda df, _: df.write.mode("append").parquet(path), feed)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))
