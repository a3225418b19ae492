"""Containment of JSON documents against a plain recursion on random nested ones."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import jsons


def inside(doc, wanted, top=True):
    number = lambda x: isinstance(x, (int, float, Decimal)) and not isinstance(x, bool)
    if isinstance(wanted, dict):
        return isinstance(doc, dict) and all(k in doc and inside(doc[k], w, False) for k, w in wanted.items())
    if isinstance(wanted, list):
        return isinstance(doc, list) and all(any(inside(x, w, False) for x in doc) for w in wanted)
    if top and isinstance(doc, list):
        return any(inside(x, wanted, False) for x in doc)
    if number(wanted):
        return number(doc) and Decimal(doc) == Decimal(wanted)
    return type(doc) is type(wanted) and doc == wanted


def random_json(rng, depth):
    kind = rng.randrange(8 if depth else 6)
    if kind < 6:
        return [None, rng.choice([True, False]), rng.choice("ab"), rng.choice([0, 1, 2]), rng.choice([1.5, 2.0, 1.0]), rng.choice(["1", "true", ""])][kind]
    n = rng.randint(0, 3)
    return [random_json(rng, depth - 1) for _ in range(n)] if kind == 6 else {rng.choice(["a", "b", "a.b", "it's", ""]): random_json(rng, depth - 1) for _ in range(n)}


def test_containment_matches_brute_force(spark):
    rng = random.Random(1)
    docs = [random_json(rng, 3) for _ in range(400)]
    wanted = [w for w in (random_json(rng, 2) for _ in range(40))] + [docs[5], docs[17], [], {}, [[]], {"a": {}}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(-1, None), (-2, "{broken"), (-3, "")], "i int, d string")
    hits = 0
    for part in range(0, len(wanted), 12):
        some = wanted[part : part + 12]
        got = df.select("i", *[jsons.contains(F.col("d"), json.dumps(w)).alias(f"w{k}") for k, w in enumerate(some)]).collect()
        for r in got:
            for k, w in enumerate(some):
                expected = r.i >= 0 and inside(docs[r.i], w)
                hits += expected
                assert r[f"w{k}"] == expected, (docs[r.i] if r.i >= 0 else r.i, w)
    assert hits > 500


@pytest.mark.parametrize(
    ("doc", "wanted", "held"),
    [("9007199254740993", "9007199254740992", False), ("9007199254740993", "9007199254740993", True), ("0.1", "0.10", True), ("1e300", "1E+300", True), ("[1, [2, 3]]", "[[3]]", True), ("[1, 2]", "2", True), ("[[2]]", "2", False), ("[null]", "null", True), ("[[null]]", "null", False), ('{"a": [1, {"b": null}]}', '{"a": [{"b": null}]}', True)],
)
def test_edges(spark, doc, wanted, held):
    assert spark.createDataFrame([(doc,)], "d string").select(jsons.contains(F.col("d"), wanted)).first()[0] is held
