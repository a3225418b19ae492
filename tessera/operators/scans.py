"""Partial scans: by keys, since a point in time, in pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written


def by_keys(df: DataFrame, key: str, keys: DataFrame | list) -> DataFrame:
    """Rows whose key is among ``keys``: a short list becomes a pushed-down IN, a frame a semi join."""
    if isinstance(keys, list) and len(keys) <= 1000:
        return df.where(F.col(key).isin(keys))
    if isinstance(keys, list):
        keys = df.sparkSession.createDataFrame([(k,) for k in keys], f"`{key}` {df.schema[key].dataType.simpleString()}")
    return df.join(keys.select(key), key, "left_semi")


def since(df: DataFrame, time: str, start: DataFrame) -> DataFrame:
    """Rows after the time in the one-row frame ``start`` (start); all rows where that is null.

    The start is read first, so that the scan gets a literal to push down.
    """
    at = start.first()[0]
    return df if at is None else df.where(F.col(time) > F.lit(at).cast(df.schema[time].dataType))


def cursor_pages(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows with the number of the page that reading on from the last key gives them: rows before a row, by range partitions.

    Keys are unique.  Only one count a partition passes through the global window.  Partitions are written once: made twice, their bounds would come from
    two samples and their numbers from two ways of joining small ones, and counts would not fit the rows.
    """
    placed = written(df.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "placed")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    n = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1 + F.col("__before")
    return placed.join(F.broadcast(before), "__part").withColumn("page", F.floor(n / size).cast("int")).drop("__part", "__before")
