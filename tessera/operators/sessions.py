"""Ordered scans of events by user: gaps, islands, pairs, and greedy rules that lag() cannot express.

Greedy rules (a dropped event is no predecessor of the next) run as folds over one user's events.  The folds are plain functions on
(state, event), the same in batch and in streaming.  In batch, rows are partitioned by user and sorted by time, and a task
passes over them with the state of one user, so that a user with many events needs no more memory than others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

#: fold(state, time in microseconds, kind) -> (new state, value for the event); state is None at first.
Fold = Callable[[object, int, object], tuple[object, object]]


def gap_seconds(df: DataFrame, keys: list[str], time: str, kind: str, *order: str) -> Column:
    """Seconds since the event before, null where that has the same kind."""
    w = Window.partitionBy(*keys).orderBy(time, *order)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = (micros(F.col(time)) - micros(F.lag(time).over(w))) / F.lit(1_000_000)
    return F.when(F.lag(kind).over(w) == F.col(kind), F.lit(None)).otherwise(gap)


def islands(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, first, last, length) of runs of consecutive ordinals."""
    w = Window.partitionBy(key).orderBy(ordinal)
    runs = df.select(key, ordinal).distinct().withColumn("__run", F.col(ordinal) - F.row_number().over(w))
    return runs.groupBy(key, "__run").agg(F.min(ordinal).alias("first"), F.max(ordinal).alias("last"), F.count(F.lit(1)).alias("length")).drop("__run")


def folded(df: DataFrame, key: str, time: str, kind: str, order: list[str], fold: Fold, name: str, value: object = None) -> DataFrame:
    """``df`` with the value that the fold gives each event, its user's events taken in order of time and ``order``."""
    rows = df.withColumn("__micros", F.unix_micros(F.col(time).cast("timestamp"))).repartition(key).sortWithinPartitions(key, "__micros", *order)
    at = [rows.columns.index(c) for c in (key, "__micros", kind)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state, started = None, None, False
        for batch in batches:
            out = []
            for k, t, x in zip(*(batch.iloc[:, i] for i in at)):
                if not started or (k != user and not (pd.isna(k) and pd.isna(user))):
                    user, state, started = k, None, True
                state, got = fold(state, int(t), x)
                out.append(got)
            yield batch.assign(**{name: pd.Series(out, index=batch.index, dtype="object")})

    schema = StructType([*rows.schema.fields, StructField(name, value or BooleanType())])
    return rows.mapInPandas(run, schema).drop("__micros")


def debounce(seconds: float, same_kind: bool) -> Fold:
    """True for an event that counts: not within ``seconds`` after the last that counted (of the same kind, if asked)."""

    def fold(state: dict | None, t: int, kind: object) -> tuple[dict, bool]:
        last = dict(state or {})
        k = kind if same_kind else ""
        keep = k not in last or not 0 <= t - last[k] < seconds * 1_000_000
        if keep:
            last[k] = t
        return last, keep

    return fold


def paired(enter: str, leave: str) -> Fold:
    """For a leaving event the time of the open entry, which it closes; later entries replace an open one."""

    def fold(state: int | None, t: int, kind: object) -> tuple[int | None, int | None]:
        if kind == enter:
            return t, None
        if kind == leave and state is not None:
            return None, state
        return state, None

    return fold


LONG = LongType()
