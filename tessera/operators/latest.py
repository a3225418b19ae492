"""One row per key: latest, first, last, distinct on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in the given order; ``rank`` keeps their number under that name.

    Null keys form a group of their own.  The order must end in a unique column to be deterministic.  The filter on the
    row number lets Spark cut each task's groups before the shuffle.
    """
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def latest_per(df: DataFrame, keys: Sequence[str], *newest: str) -> DataFrame:
    """The row of each key with the largest values of ``newest``, nulls last."""
    return top_per(df, keys, [F.col(c).desc_nulls_last() for c in newest])


def first_by_hash(df: DataFrame, content: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each content, by SHA-256."""
    return top_per(df.withColumn("content_hash", F.sha2(F.col(content), 256)), ["content_hash"], order)


def last_by_key(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Later rows overwrite earlier ones with the same key."""
    return top_per(df, keys, [F.col(position).desc_nulls_last()])
