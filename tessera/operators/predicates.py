"""Conditions from rows: a small filter language compiled to Columns, and filters that depend on what matches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def condition(field: str, method: str, value: object = None) -> Column:
    """One condition.  ``empty`` means exactly the empty text, so null is not empty; unknown methods pass."""
    c = F.col(field)
    values = value if isinstance(value, (list, tuple)) else [value]
    match method:
        case "eq":
            out = c == F.lit(value)
        case "ne":
            out = ~c.eqNullSafe(F.lit(value))
        case "like":
            out = F.contains(c, F.lit(value))
        case "in":
            out = c.isin(list(values))
        case "nin":
            out = ~F.coalesce(c.isin(list(values)), F.lit(False))
        case "range":
            low, high = (*values, None)[:2]
            out = reduce(lambda a, b: a & b, [x for x in (c >= F.lit(low) if low is not None else None, c <= F.lit(high) if high is not None else None) if x is not None], F.lit(True))
        case "empty":
            out = c == F.lit("")
        case "not_empty":
            out = c.isNull() | (c != F.lit(""))
        case _:
            out = F.lit(True)
    return F.coalesce(out, F.lit(False))


def compiled(conditions: Sequence[tuple], rel: str = "and") -> Column:
    """All (and) or any (or) of conditions (field, method, value); none at all passes."""
    parts = [condition(*c) for c in conditions]
    if not parts:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if rel == "and" else (lambda a, b: a | b), parts)


def given(df: DataFrame, **equal: object) -> DataFrame:
    """Rows with the given values; a parameter that is None adds no predicate."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def not_switched_off(df: DataFrame, flags: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows whose flag is not explicitly false; keys without a flag stay."""
    return df.join(flags.where(~F.col(flag)).select(key), key, "left_anti")


def like_or_all(df: DataFrame, field: str, part: str) -> DataFrame:
    """Rows whose field contains ``part``, or all rows where none does; the one-row count is joined, so the plan stays declarative."""
    hit = F.contains(F.col(field), F.lit(part))
    hits = df.agg(F.count_if(hit).alias("__hits"))
    return df.join(F.broadcast(hits)).where(hit | (F.col("__hits") == 0)).drop("__hits")


def applicable(types: Column, wanted: Column, unknown: str = "unknown", common: str = "common") -> Column:
    """Whether a list of types applies: the wanted one is unknown or unset, the list is empty, or it has ``common`` or the wanted one."""
    any_type = wanted.isNull() | (wanted == unknown) | types.isNull() | (F.size(types) == 0)
    return any_type | F.array_contains(types, common) | F.coalesce(F.array_contains(types, wanted), F.lit(False))


def header_like(parts: Column, headers: Sequence[str], hints: Sequence[str]) -> Column:
    """Whether a row's texts look like a header: one of them is a header word, and none has a hint, a colon or an option mark."""
    is_header = F.exists(parts, lambda x: F.trim(x).isin(list(headers)))
    speaks = F.exists(parts, lambda x: x.rlike("[:：]|\\[ ?\\]|\\[SEL\\]") | reduce(lambda a, b: a | b, [F.contains(x, F.lit(h)) for h in hints], F.lit(False)))
    return F.coalesce(is_header & ~speaks, F.lit(False))


def numbered(df: DataFrame, *order: Column, name: str = "n") -> DataFrame:
    """Rows with their number in a total order; for frames of a few rows."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
