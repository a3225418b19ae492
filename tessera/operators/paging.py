"""Paging by offset and by cursor, sort orders from text, chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_columns(spec: str, allowed: set[str], unique: str) -> list[Column]:
    """Columns of ``field:ORDER,...``; a field that is not allowed is an error, and a unique column ends the order."""
    out = []
    for part in filter(None, spec.split(",")):
        field, _, order = part.partition(":")
        if field not in allowed:
            raise ValueError(f"cannot sort by {field!r}")
        out.append(F.col(field).desc_nulls_last() if order == "DESCEND" else F.col(field).asc_nulls_last())
    return [*out, F.col(unique)]


def page(df: DataFrame, order: Sequence[Column], page: int = 1, size: int = 20, most: int = 100) -> DataFrame:
    """Rows of a page (from 1) with the total beside them; a page has at most ``most`` rows."""
    size = max(1, min(size, most))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size).crossJoin(F.broadcast(total))


def after(df: DataFrame, cursor: Sequence[tuple[str, object, bool]], size: int) -> DataFrame:
    """The next rows after a cursor of (column, value, ascending); the columns together are unique."""
    beyond, equal = F.lit(False), F.lit(True)
    for name, value, up in cursor:
        c, v = F.col(name), F.lit(value).cast(df.schema[name].dataType)
        beyond = beyond | (equal & ((c > v) if up else (c < v)))
        equal = equal & (c == v)
    return df.where(beyond).orderBy(*[F.col(n).asc() if up else F.col(n).desc() for n, _, up in cursor]).limit(size)


def chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int, name: str = "chunk") -> DataFrame:
    """Rows with the number of their chunk of ``size`` rows within their key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, F.floor((n - 1) / size).cast("long"))
