"""Streaming forms of the event operators.

Each is a function from a streaming frame to a streaming frame and gives the same rows as its batch form.  ``run`` reads a folder
as a stream until its end and returns what came out, for queries and tests.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tessera.operators.sessions import Fold
from tessera.session import shared_folder


def source(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A folder of Parquet files as a stream: what has come into it makes the next micro-batch."""
    return spark.readStream.schema(schema).parquet(path)


def run(stream: DataFrame, feed: Sequence[Callable[[], None]] = (), mode: str = "append") -> DataFrame:
    """All rows that a stream gives, by way of a table in the shared folder; after each step of ``feed``, which brings new input, it goes on where it was."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    for step in feed or (lambda: None,):
        step()
        writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """A stream with a watermark; times without zone become timestamps in the session's zone first."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return timed(stream, time, delay).dropDuplicatesWithinWatermark(keys)


#: Buckets of keys whose state lies together: groups, frames and calls to the state store are counted by buckets, not by keys.
BUCKETS = 4096


def _told(key: str) -> Column:
    """A key as a string that is never null, in which keys of one bucket differ."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def _key(stream: DataFrame, key: str) -> Column:
    """The key that ``_told`` made a string of."""
    return F.when(F.col("__who") != "", F.expr("substr(__who, 2)")).cast(stream.schema[key].dataType).alias(key)


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(_told(key)), F.lit(BUCKETS)).cast("int")


def folded(stream: DataFrame, key: str, time: str, kind: str, order: list[str], fold: Fold, name: str) -> DataFrame:
    """What a fold gives each event of its user; a user's state goes on from batch to batch.

    Events of one batch are folded in order of time; an event that comes later than a batch with younger ones is folded as late as it comes.  A task
    holds the events of one bucket of users in a micro-batch, which the source's limits bound.
    """
    rows = stream.withColumns({"__micros": F.unix_micros(F.col(time).cast("timestamp")), "__who": _told(key), "__bucket": _bucket(key)})
    long = not isinstance(fold(None, 0, "")[1], bool)
    schema = StructType([*stream.schema.fields, StructField(name, LongType() if long else BooleanType())])
    columns = stream.columns

    def update(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else {}
        events = pd.concat(list(batches), ignore_index=True).sort_values(["__micros", *order], kind="stable")
        out = []
        for who, t, k in zip(events["__who"], events["__micros"], events[kind]):
            now[who], got = fold(now.get(who), int(t), k)
            out.append(got)
        state.update((json.dumps(now),))
        yield events[columns].assign(**{name: pd.Series(out, index=events.index, dtype="object")})

    return rows.groupBy("__bucket").applyInPandasWithState(update, schema, "folded string", "append", GroupStateTimeout.NoTimeout)


def counted(stream: DataFrame, keys: list[str], time: str, width: str, delay: str) -> DataFrame:
    """(start, keys, n) for each window of time once the watermark has passed it; later events are dropped."""
    counts = timed(stream, time, delay).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), *keys, "n")


def overdue(stream: DataFrame, key: str, time: str, kind: str, leave: str, enter: str, minutes: tuple[int, ...], delay: str) -> DataFrame:
    """(key, left, minutes) of alarms for exits without an entry within so many minutes, by timers in event time.

    The open exits of a bucket of users are its state.  A user's entry ends theirs, with the alarms that were due before it; where none comes, a timer raises each
    alarm once the watermark has passed its time.
    """
    spans = sorted(m * 60_000_000 for m in minutes)
    rows = timed(stream, time, delay).select(time, kind, F.unix_micros(time).alias("__micros"), _told(key).alias("__who"), _bucket(key).alias("__bucket"))

    def update(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() * 1000
        exits: dict[str, list[list[int]]] = json.loads(state.get[0]) if state.exists else {}  # of each user [time, alarms raised]
        alarms: list[tuple[str, int, int]] = []

        def raise_before(who: str, t: int) -> None:
            for x in exits.get(who, ()):
                while x[1] < len(spans) and x[0] + spans[x[1]] < t:
                    alarms.append((who, x[0], spans[x[1]] // 60_000_000))
                    x[1] += 1

        if not state.hasTimedOut:
            events = pd.concat([b[["__who", "__micros", kind]] for b in batches]).sort_values("__micros", kind="stable")
            for who, t, k in zip(events["__who"], events["__micros"], events[kind]):
                if k == enter:
                    raise_before(who, int(t))
                    exits[who] = [x for x in exits.get(who, ()) if x[0] >= t]
                elif k == leave:
                    exits.setdefault(who, []).append([int(t), 0])
        for who in exits:
            raise_before(who, now)
        exits = {who: left for who, x in exits.items() if (left := [e for e in x if e[1] < len(spans)])}
        if exits:
            state.update((json.dumps(exits),))
            state.setTimeoutTimestamp(max(min(e[0] + spans[e[1]] for x in exits.values() for e in x) // 1000, now // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"__who": [a[0] for a in alarms], "left": pd.to_datetime([a[1] for a in alarms], unit="us"), "minutes": [a[2] for a in alarms]})

    raised = rows.groupBy("__bucket").applyInPandasWithState(update, "__who string, left timestamp, minutes int", "exits string", "append", GroupStateTimeout.EventTimeTimeout)
    return raised.select(_key(stream, key), "left", "minutes")


#: Rows of a piece.
PIECE = 256


class Stays(StatefulProcessor):
    """Entries and exits of the keys of one bucket, paired in order of their times once the watermark has passed these, whatever the order they came in.

    What waits lies in a map of pieces, each a few rows in order of time under its first millisecond; a timer is set for the first of them.  When it fires, the
    pieces that the watermark has reached are merged: a piece is opened when the merge comes to its first row, so a bucket holds the pieces that overlap at one time
    and not all of its events, and costs a few calls for a batch, not some for each event or key.  A record that comes again while it waits counts once.  The open
    entries of the bucket's keys are the only other state; with ``longest`` one is told without an exit after so many milliseconds.
    """

    def __init__(self, enter: str, leave: str, longest: int | None):
        self.enter, self.leave, self.longest = enter, leave, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, piece string", "events string")
        self.open = handle.getValueState("open", "entries string")

    def _keep(self, rows: list[tuple[int, int, str, str]]) -> None:
        """Keep rows (micros, id, key, kind), in order of time, until the watermark has passed them."""
        for i in range(0, len(rows), PIECE):
            piece = rows[i : i + PIECE]
            self.waiting.updateValue((piece[0][0] // 1000, uuid.uuid4().hex), (json.dumps(piece),))
        self.handle.registerTimer(rows[0][0] // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            who = batch["who"].tolist() if "who" in batch else [key[0]] * len(batch)
            if who:
                self._keep(sorted(zip(batch["micros"].tolist(), batch["record"].tolist(), who, batch["kind"].tolist())))
        return iter(())

    def _passed(self, now: int) -> Iterator[tuple[int, int, str, str]]:
        """The waiting rows of milliseconds before ``now`` in order of time, each once; what is left of their pieces is kept anew."""
        pieces = sorted(self.waiting.keys())
        due = [k for k in pieces if k[0] < now]
        if len(due) < len(pieces):
            self.handle.registerTimer(pieces[len(due)][0] + 1)
        heap: list[tuple[int, int, str, str]] = []
        n, before = 0, None
        while n < len(due) or heap:
            while n < len(due) and (not heap or due[n][0] <= heap[0][0] // 1000):
                for row in json.loads(self.waiting.getValue(due[n])[0]):
                    heappush(heap, tuple(row))
                self.waiting.removeKey(due[n])
                n += 1
            if heap[0][0] // 1000 >= now:  # so is all that follows, and every piece that is due begins earlier
                self._keep(sorted(heap))
                return
            row = heappop(heap)
            if row[:3] != before:
                yield row
            before = row[:3]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        began = self.open.get()[0] if self.open.exists() else None
        held: dict[str, list[int]] = json.loads(began) if began else {}  # of each key the id and time of its open entry

        def overdue(who: str, t: int) -> bool:
            return self.longest is not None and who in held and held[who][1] // 1000 + self.longest <= t

        for t, i, who, kind in self._passed(now):
            if overdue(who, t // 1000):
                out.append((who, *held.pop(who), None, None))
            if kind == self.enter:
                held[who] = [i, t]
            elif kind == self.leave and who in held:
                out.append((who, *held.pop(who), i, t))
            if len(out) >= 10_000:
                yield self._told(out)
                out = []
        out += [(who, *held.pop(who), None, None) for who in list(held) if overdue(who, now - 1)]
        if not held and began:
            self.open.clear()
        elif held and (ends := json.dumps(held)) != began:
            self.open.update((ends,))
            if self.longest is not None:
                self.handle.registerTimer(min(at for _, at in held.values()) // 1000 + self.longest + 1)
        if out:
            yield self._told(out)

    def _told(self, out: list[tuple]) -> pd.DataFrame:
        times = lambda k: pd.to_datetime(pd.Series([x[k] for x in out], dtype="Int64"), unit="us")
        ids = lambda k: pd.Series([x[k] for x in out], dtype="Int64")
        return pd.DataFrame({"__who": pd.Series([x[0] for x in out], dtype=object), "entry": ids(1), "entered": times(2), "exit": ids(3), "left": times(4)})

    def close(self) -> None:
        pass


def stays(stream: DataFrame, key: str, time: str, kind: str, record: str, enter: str, leave: str, delay: str, longest: int | None = None) -> DataFrame:
    """(key, entry, entered, exit, left): for each exit the open entry of its key, by their record ids (long) and times.

    Events may come in any order within the watermark's ``delay``, and more than once.  A later entry replaces an open one; what the watermark has not
    passed waits.  Events without a time are left out.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # a batch writes what it changes, not a copy of its store
    rows = timed(stream, time, delay).where(F.col(time).isNotNull()).select(_bucket(key).alias("bucket"), F.col(time).alias("at"), F.col(kind).alias("kind"), F.col(record).cast("long").alias("record"), F.unix_micros(time).alias("micros"), _told(key).alias("who"))
    paired = rows.groupBy("bucket").transformWithStateInPandas(Stays(enter, leave, longest), "__who string, entry long, entered timestamp, exit long, left timestamp", "Append", "EventTime")
    return paired.select(_key(stream, key), "entry", "entered", "exit", "left")


def in_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], feed: Sequence[Callable[[], None]] = ()) -> None:
    """Hands each micro-batch to a function, one after the other; a batch never overlaps the next."""
    folder = f"{shared_folder(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", folder).trigger(availableNow=True)
    for step in feed or (lambda: None,):
        step()
        writer.start().awaitTermination()
