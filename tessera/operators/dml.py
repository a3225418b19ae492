"""Writes as rewrites: each function returns the table as it is after the write.

Keys are compared null-safely.  The source must hold a key once; callers deduplicate it first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _on(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], guard: Callable[[], Column] | None = None) -> DataFrame:
    """Source rows replace target rows with their keys or are added.

    With a guard, a condition over t.* (old) and s.* (new), only rows for which it holds are replaced.
    """
    t = target.withColumn("__t", F.lit(True)).alias("t")
    s = source.withColumn("__s", F.lit(True)).alias("s")
    both = t.join(s, _on(keys), "full")
    take = F.col("s.__s").isNotNull()
    if guard is not None:
        take = take & (F.col("t.__t").isNull() | F.coalesce(guard(), F.lit(False)))
    return both.select(*[F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) if c in source.columns else F.col(f"t.{c}").alias(c) for c in target.columns])


def differs(columns: Sequence[str]) -> Callable[[], Column]:
    """A guard: some column has another value than before."""
    return lambda: reduce(lambda a, b: a | b, (~F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in columns))


def insert_ignore(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the source rows whose keys the target lacks."""
    return target.unionByName(source.alias("s").join(target.alias("t"), _on(keys), "left_anti").select(*target.columns))


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sets columns of the target rows that the source has; null in the source keeps the old value."""
    joined = target.alias("t").join(source.alias("s"), _on(keys), "left")
    return joined.select(*[F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}")).alias(c) if c in columns else F.col(f"t.{c}") for c in target.columns])


def add_counts(target: DataFrame, usage: DataFrame, key: str, counter: str) -> DataFrame:
    """Adds to a counter how often each key occurs in ``usage``; usage is counted before it is joined."""
    counts = usage.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return target.join(counts, key, "left").withColumn(counter, F.col(counter) + F.coalesce("__n", F.lit(0))).select(*target.columns)


def delete_stale(target: DataFrame, keep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keeps the rows whose keys ``keep`` has; nulls there remove nothing by accident, as NOT IN would."""
    return target.alias("t").join(keep.alias("s"), _on(keys), "left_semi")
