"""Quote rules: prices fold over the rules in order of priority, grades and delivery stop at the first match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds(condition: dict, columns: dict[str, str]) -> Column:
    """One condition {field, operator, value}: numbers compare as numbers where both are; unknown fields and operators fail."""
    if condition["field"] not in columns:
        return F.lit(False)
    c, value = F.col(condition["field"]), condition["value"]
    text = columns[condition["field"]] == "string"
    try:
        number = float(value)
    except ValueError:
        number = None
    numeric = (c.try_cast("double") if text else c.cast("double")) if number is not None else None
    match condition["operator"]:
        case "=":
            plain = c.cast("string") == F.lit(str(value))
            return plain if numeric is None else F.when(numeric.isNotNull(), numeric == number).otherwise(plain)
        case ">":
            return F.lit(False) if numeric is None else numeric > number
        case "<":
            return F.lit(False) if numeric is None else numeric < number
        case "contains":
            return F.contains(F.coalesce(c.cast("string"), F.lit("")), F.lit(str(value)))
    return F.lit(False)


def matches(rule: dict, columns: dict[str, str]) -> Column:
    """Whether a rule applies to a row: active, its conditions by its relation; without conditions always."""
    if not rule.get("active", True):
        return F.lit(False)
    parts = [F.coalesce(holds(c, columns), F.lit(False)) for c in rule.get("conditions") or ()]
    if not parts:
        return F.lit(True)
    return reduce((lambda a, b: a | b) if rule.get("relation") == "or" else (lambda a, b: a & b), parts)


def apply_rules(df: DataFrame, rules: list[dict], price: str, quantity: str) -> DataFrame:
    """``df`` with its price after all price rules, and grade and delivery_days of the first rule of those kinds that matches.

    Each price rule sees the price that the ones before it left; a first match ends the search even where its value is null.
    """
    columns = dict(df.dtypes)
    kind = lambda k: sorted((r for r in rules if r["ruleType"] == k), key=lambda r: r.get("priority", 0))
    first = lambda k, field, t: reduce(lambda later, r: F.when(matches(r, columns), F.lit(r.get(field)).cast(t)).otherwise(later), reversed(kind(k)), F.lit(None).cast(t))
    out = df.withColumns({"grade": first("grade", "grade", "string"), "delivery_days": first("delivery", "deliveryDays", "int")})
    for r in kind("price"):
        if r.get("step"):
            new = F.ceil(F.col(quantity) / r["step"]["interval"]) * F.lit(float(r["step"]["amount"]))
        elif r.get("addition"):
            new = F.coalesce(F.col(price), F.lit(0.0)) + F.lit(float(r["addition"]))
        else:
            continue
        out = out.withColumn(price, F.when(matches(r, columns), new.cast("double")).otherwise(F.col(price)))
    return out


def triggered(df: DataFrame, triggers: list[tuple[str, Column]], key: str) -> DataFrame:
    """(key, action) for every trigger whose condition a changed record meets: rows of actions, no side effects."""
    fired = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in triggers]), lambda x: x.isNotNull())
    return df.select(key, F.explode(fired).alias("action"))
