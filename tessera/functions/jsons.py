"""Semi-structured values: paths, guards, keys, edits, and array functions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from decimal import Context, Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_path(document: Column, paths: Sequence[str]) -> Column:
    """The first non-empty text among several paths of a JSON text."""
    return F.coalesce(*[F.nullif(F.get_json_object(document, p), F.lit("")) for p in paths])


def array_or_empty(document: Column, element: str) -> Column:
    """A JSON array as array<element>; anything else is an empty one."""
    is_array = F.ltrim(document).startswith("[")
    return F.coalesce(F.from_json(F.when(is_array, document), f"array<{element}>"), F.array().cast(f"array<{element}>"))


def none_violates(rows: Column, bad) -> Column:
    """Whether no element is bad; an element for which that is unknown does not count as bad."""
    return ~F.coalesce(F.exists(rows, lambda x: F.coalesce(bad(x), F.lit(False))), F.lit(False))


def any_matches(rows: Column, good) -> Column:
    return F.coalesce(F.exists(rows, lambda x: F.coalesce(good(x), F.lit(False))), F.lit(False))


def without(entries: Column, keys: Sequence[str]) -> Column:
    """A map without some keys."""
    return F.map_filter(entries, lambda k, _: ~k.isin(list(keys)))


def truthy(entries: Column) -> Column:
    """A map<string, string> without null, empty, zero and false values."""
    return F.map_filter(entries, lambda _, v: v.isNotNull() & ~v.isin("", "0", "false"))


def compact(values: Column) -> Column:
    """An array without null and empty texts."""
    return F.filter(values, lambda x: x.isNotNull() & (x != ""))


def covers(whole: Column, parts: Column) -> Column:
    """Whether every element of ``parts`` is in ``whole``."""
    return F.size(F.array_except(parts, whole)) == 0


def union_ordered(*arrays: Column) -> Column:
    """Distinct elements in order of first appearance."""
    return F.array_distinct(F.concat(*arrays))


def _object(v: Column) -> Column:
    """A variant object by key; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _number(v: Column, wanted: int | Decimal | float) -> Column:
    """Whether a variant is a number equal to another, exactly where 38 digits with 18 behind the point hold it."""
    near = F.try_variant_get(v, "$", "double") == F.lit(float(wanted))
    exact = Decimal(wanted) if not isinstance(wanted, float) else Decimal(repr(wanted))
    if abs(exact) >= 10**19 or exact != exact.quantize(Decimal(1).scaleb(-18), context=Context(prec=60)):
        return near
    return near & F.coalesce(F.try_variant_get(v, "$", "decimal(38,18)") == F.lit(exact).cast("decimal(38,18)"), F.lit(False))


def _holds(v: Column, wanted: object, top: bool) -> Column:
    kind = F.schema_of_variant(v)
    if wanted is None:
        alone = F.is_variant_null(v)
    elif isinstance(wanted, bool):
        alone = (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(wanted))
    elif isinstance(wanted, str):
        alone = (kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(wanted))
    elif isinstance(wanted, (int, float, Decimal)):
        alone = (kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & _number(v, wanted)
    elif isinstance(wanted, dict):
        inside = _object(v)
        return reduce(lambda x, y: x & y, [F.coalesce(_holds(F.try_element_at(inside, F.lit(k)), w, False), F.lit(False)) for k, w in wanted.items()], inside.isNotNull())
    else:
        items = F.try_variant_get(v, "$", "array<variant>")
        return reduce(lambda x, y: x & y, [_some_holds(items, w) for w in wanted], items.isNotNull())
    if top:  # a list of scalars contains each of them
        alone = alone | F.coalesce(_some_holds(F.try_variant_get(v, "$", "array<variant>"), wanted), F.lit(False))
    return alone


def _some_holds(items: Column, wanted: object) -> Column:
    """Whether an element of a list of variants contains a value."""
    return F.exists(items, lambda x: F.coalesce(_holds(x, wanted, False), F.lit(False)))


def contains(document: Column, wanted: str) -> Column:
    """Whether a JSON text contains another: objects by key, lists by membership in any order, scalars by value, at any depth.

    A list contains a scalar that is one of its elements, at the top only.  Numbers are compared by value.  Null and broken documents contain nothing.
    The wanted text is compiled into the expression; the document is parsed once, as a variant.
    """
    return F.coalesce(_holds(F.try_parse_json(document), json.loads(wanted, parse_float=Decimal), True), F.lit(False))
