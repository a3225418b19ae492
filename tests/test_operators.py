"""Operators against brute force on small made-up tables."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import aliases as alias_operators
from tessera.operators import dictionary, normalize, ranges, residues


@pytest.mark.parametrize("shipped", [0, alias_operators.SHIPPED])
def test_contained_aliases_match_brute_force(spark, shipped):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randint(0, n)))
    texts = [(i, rng.choice("xy"), word(12)) for i in range(120)] + [(120, "x", None)]
    aliases = [(rng.choice("xy"), word(4), k) for k in range(60)]
    t = spark.createDataFrame(texts, "id int, kind string, t string")
    a = spark.createDataFrame(aliases, "kind string, alias string, n int")
    got = sorted((r.id, r.n) for r in alias_operators.containing(t, a, "t", "alias", ["kind"], shipped).collect())
    assert got == sorted((i, n) for i, kind, x in texts for k, alias, n in aliases if kind == k and alias and x and alias in x)


def test_ten_thousand_aliases_in_whole_documents(spark):
    """Aliases of which some lie inside others, all found in one pass and again without shipping them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    given = {r.doc_id: r.text or "" for r in docs.collect()}
    rng = random.Random(3)
    texts = [t for t in given.values() if len(t) > 20]
    known = set()
    while len(known) < 10_000:
        t = rng.choice(texts)
        at = rng.randrange(len(t) - 12)
        known.add(t[at : at + rng.randint(3, 12)])
    a = spark.createDataFrame([(x,) for x in sorted(known)], "alias string")
    met = alias_operators.containing(docs, a, "text", "alias")
    assert "Exchange hashpartitioning(text" not in met._jdf.queryExecution().toString()
    counted = {r.doc_id: (r.n, r.longest) for r in met.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("alias")).alias("longest")).collect()}
    for i in sorted(given)[::10]:
        inside = [x for x in known if x in given[i]]
        assert counted.get(i, (0, None)) == (len(inside), max(map(len, inside), default=None))


def test_longest_prefixes_match_brute_force(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab板") for _ in range(rng.randint(0, n)))
    values, known = [(i, word(8)) for i in range(200)] + [(200, None)], {word(5) for _ in range(25)}
    v, a = spark.createDataFrame(values, "id int, v string"), spark.createDataFrame([(x,) for x in known], "a string")
    got = {r.id: (r.alias, r.suffix, r.confidence) for r in alias_operators.longest_prefixes(v, a, "v", "a").collect()}
    for i, x in values:
        best = max((k for k in known if k and x and x.startswith(k)), key=len, default=None)
        rest = x[len(best) :] if best else ""
        stands = best and (not rest or len(best) >= 3 or "板" in rest)
        assert got[i] == ((best, rest or None, 0.9 if rest else 1.0) if stands else (None, None, None))


def test_qualifiers_match_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abC ") for _ in range(rng.randint(0, n)))
    rows = [(f"k{i}", rng.choice(["position", "area", "layer", "other", None]), word(3), [word(3), None, word(2)] if i % 4 else None, rng.choice([None, 5, 7]), rng.choice([None, 3])) for i in range(30)]
    texts = [(i, p, rng.choice([word(6), word(6), None])) for i in range(60) for p in range(3)]
    got = dictionary.qualifiers(spark.createDataFrame(texts, "id int, place int, text string"), spark.createDataFrame(rows, "key string, kind string, name string, aliases array<string>, sort_order int, specificity int"))
    compact = lambda t: "".join((t or "").split()).lower()
    rules = [(kind, compact(a), key, order if order is not None else 100, special or 0) for key, kind, name, more, order, special in rows if kind in dictionary.QUALIFIER_KINDS and name for a in (name, *(more or []), key) if compact(a)]
    want = []
    for i in range(60):
        for _, place, t in sorted(x for x in texts if x[0] == i and x[2]):
            hits = [r for r in rules if r[1] in compact(t)]
            if hits:
                for kind in {h[0] for h in hits}:
                    best = min((h for h in hits if h[0] == kind), key=lambda h: (-len(h[1]), -h[4], h[3], h[2], h[1]))
                    want.append((i, place, kind, best[2], best[1]))
                break
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 30


def test_votes_match_brute_force(spark):
    rng = random.Random(2)
    value = lambda: rng.choice(("a", "b", "", None))
    items, master = [(i, value(), value(), value()) for i in range(150)], [(i, value(), value(), value()) for i in range(12)]
    schema = "{} int, p string, q string, r string"
    got = {r.item: (r.m, r.votes) for r in ranges.attribute_vote(spark.createDataFrame(items, schema.format("item")), spark.createDataFrame(master, schema.format("m")), "item", "m", ["p", "q", "r"]).collect()}
    want = {}
    for i, *x in items:
        fits = []
        for m, *y in master:
            votes = sum(bool(a) and a == b for a, b in zip(x, y))
            if votes >= 2 and not any(a and b and a != b for a, b in zip(x, y)):
                fits.append((m, votes))
        if len(fits) == 1:
            want[i] = fits[0]
    assert got == want


def test_residues(spark):
    rows = [("application", "PE 板", "reroute"), ("application", "PE", "candidate"), ("deckle_type", "挡块30", "suppress"), (None, None, "suppress"), ("color", "红", "candidate")]
    df = spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(rows)], "i int, t string, v string")
    got = [r[0] for r in df.orderBy("i").select(residues.fate(F.col("t"), F.col("v"), ("pe",))).collect()]
    assert got == [r[2] for r in rows]


def test_lists_wholes_and_unknown_names(spark):
    fields = [(1, 1, "材料", "PE / PP"), (1, 1, "材料", "POM ABS"), (1, 1, "材料2", "PE"), (1, 2, "厚度", "3-5 mm"), (1, 2, "厚度", "厚"), (1, 2, "怪", "x"), (1, 2, "备用", None), (2, 1, "合同号", "C7")]
    f = spark.createDataFrame(fields, "doc int, item int, name string, value string")
    items = spark.createDataFrame([(1, 1, "die", "n"), (1, 2, None, "big die here"), (2, 1, None, None)], "doc int, item int, hint string, name string")
    types = spark.createDataFrame([("die", "D")], "alias string, product_type string")
    names = spark.createDataFrame([("材料", "material", "enum"), ("厚度", "thickness", "number"), ("备用", "spare", "text")], "alias string, term_type string, value_kind string")
    aliases = spark.createDataFrame([("material", "pe", 1), ("material", "pp", 2), ("material", "pom abs", 3)], "term_type string, alias string, term_id int")
    said = normalize.matched(normalize.rewritten(f.where("doc = 1"), names), names, aliases)
    got = sorted((r.item, r.term_type or "", r["index"] or 0, r.kind, r.text or "") for r in said.collect())
    assert got == [
        (1, "material", 0, "term", "1"), (1, "material", 0, "term", "2"), (1, "material", 0, "term", "3"), (1, "material", 2, "term", "1"),
        (2, "", 0, "name_candidate", "怪"), (2, "spare", 0, "text", ""), (2, "thickness", 0, "number", "3-5 mm"), (2, "thickness", 0, "text", "厚"),
    ]
    out = {r.doc: r for r in normalize.normalized(f, items, types, names, aliases, ("合同号",)).collect()}
    assert (out[1].items, out[1].fields, out[1].terms, out[1].numbers, out[1].name_candidates, out[1].product_types) == (2, 4, 4, 1, 1, ["D"])
    assert (out[2].items, out[2].fields, out[2].info, out[2].product_types) == (1, None, "C7", ["unknown"])


def test_product_types_decide_how_a_field_is_read(spark):
    """The same name and value mean another term for another type; what points to another product moves there first."""
    fields = [(1, 1, "规格", "5"), (1, 2, "规格", "5"), (1, 3, "规格", "5"), (1, 1, "液压泵规格", "7"), (2, 1, "液压泵规格", "7"), (1, 2, "只给泵", "9"), (3, 9, "规格", "5")]
    f = spark.createDataFrame(fields, "doc int, item int, name string, value string")
    items = spark.createDataFrame([(1, 1, "die", "n"), (1, 2, "pump", "n"), (1, 3, "x", "n"), (2, 1, "die", "n")], "doc int, item int, hint string, name string")
    types = spark.createDataFrame([("die", "D"), ("pump", "P")], "alias string, product_type string")
    names = spark.createDataFrame([("规格", "width", "number", ["D"]), ("规格", "size", "enum", ["P", "Q"]), ("液压泵规格", "flow", "number", None), ("只给泵", "only", "number", ["D"])], "alias string, term_type string, value_kind string, products array<string>")
    aliases = spark.createDataFrame([("size", "5", 1, ["Q"]), ("size", "5", 2, ["P"]), ("size", "5", 3, ["P"])], "term_type string, alias string, term_id int, products array<string>")
    redirects = spark.createDataFrame([("液压泵", "P"), ("泵", "D")], "word string, product_type string")
    route = normalize.routed(items, types)
    moved = normalize.redirected(f, route, redirects)
    at = {(r.doc, r.name, r.value, r.item): r.product_type for r in moved.collect()}
    assert at == {(1, "规格", "5", 1): "D", (1, "规格", "5", 2): "P", (1, "规格", "5", 3): "unknown", (1, "液压泵规格", "7", 2): "P", (2, "液压泵规格", "7", 1): "D", (1, "只给泵", "9", 1): "D", (3, "规格", "5", 9): "unknown"}
    said = sorted((r.doc, r.item, r.term_type, r.kind, r.text) for r in normalize.matched(normalize.rewritten(moved, names), names, aliases).collect())
    assert said == [
        (1, 1, "only", "number", "9"), (1, 1, "width", "number", "5"), (1, 2, "flow", "number", "7"), (1, 2, "size", "term", "2"), (1, 3, "size", "term", "1"), (1, 3, "width", "number", "5"),
        (2, 1, "flow", "number", "7"), (3, 9, "size", "term", "1"), (3, 9, "width", "number", "5"),
    ]
    alone = normalize.matched(normalize.rewritten(moved.where("name = '只给泵'").withColumn("product_type", F.lit("P")), names), names, aliases).collect()
    assert [r.term_type for r in alone] == ["only"]  # nothing applies: all rows do


def test_empty_tables(spark):
    t = spark.createDataFrame([], "id int, kind string, t string")
    a = spark.createDataFrame([], "kind string, alias string, n int")
    assert alias_operators.containing(t, a, "t", "alias").count() == alias_operators.containing(t, a, "t", "alias", shipped=-1).count() == 0
    assert alias_operators.containing(t, spark.createDataFrame([("k", "")], "kind string, alias string"), "t", "alias", ["kind"]).count() == 0
    assert alias_operators.longest_prefixes(t, a, "t", "alias").count() == 0
    assert ranges.attribute_vote(spark.createDataFrame([], "item int, p string, q string"), spark.createDataFrame([], "m int, p string, q string"), "item", "m", ["p", "q"]).count() == 0


def test_best_terms_of_any_type_match_brute_force(spark):
    rng = random.Random(5)
    fields = [(i, rng.choice(["a", "b", None]), rng.choice(["x", "y", None])) for i in range(60)]
    terms = [(i, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", "z", None]), rng.choice([1, 2, None])) for i in range(40)]
    got = dictionary.match_any_type(spark.createDataFrame(fields, "field_id int, term_type string, value string"), spark.createDataFrame(terms, "term_id int, term_type string, value string, specificity int"))
    best = lambda t, v: min((k for k in terms if v is not None and k[2] == v), key=lambda k: (t is None or k[1] != t, -(k[3] or 0), k[0]), default=None)
    assert sorted(map(tuple, got.collect())) == sorted((i, best(t, v)[0]) for i, t, v in fields if best(t, v))


def test_fields_that_say_the_same_are_matched_once(spark):
    """20,000 fields of one content: its 300 candidates are judged once, not six million times."""
    judged = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def own(g, h):
        judged.add(1)
        return g == h

    f = spark.range(20_000).select(F.col("id").alias("field_id"), F.lit("N").alias("name"), F.lit(1).alias("own"))
    names = spark.range(300).select(F.lit("n").alias("alias"), F.col("id").cast("string").alias("term_type"), (F.col("id") % 3).cast("int").alias("g"))
    assert dictionary.match_term_types(f, names, own("g", "own")).count() == 20_000 * 100
    assert judged.value < 20_000


def test_fields_are_not_broadcast_to_their_answers(spark, tmp_path):
    """Many fields of few contents take little room in files; the answers are the smaller side."""
    spark.range(50_000).select(F.col("id").alias("field_id"), F.concat(F.lit("n"), (F.col("id") % 4).cast("string")).alias("name"), (F.col("id") % 3).alias("own")).write.parquet(str(tmp_path / "f"))
    f = spark.read.parquet(str(tmp_path / "f"))
    names = spark.createDataFrame([(f"n{i}", f"t{j}", j % 3) for i in range(4) for j in range(6)], "alias string, term_type string, g long")
    got = dictionary.match_term_types(f, names, F.col("g") == F.col("own"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
    assert got.count() == 50_000 * 2


def test_what_fields_say_is_shuffled_once_and_counted_once(spark):
    rng = random.Random(4)
    kinds = [rng.choice([0, 1, 2, 3, 4]) for _ in range(12)]
    rows = [(rng.randrange(6), rng.choice([None, 1, 2]), rng.choice([None, 7, 8]), w) for w in (rng.randrange(12) for _ in range(400))]
    rows = [(d, i, s, kinds[w], w) for d, i, s, w in rows]
    got = normalize._gathered(spark.createDataFrame(rows, "doc long, item int, slot long, kind int, what long"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # one for each count before
    expected = []
    for doc in {r[0] for r in rows}:
        of = {r[1:] for r in rows if r[0] == doc}
        told = [sum(1 for r in of if r[2] == k) for k in (1, 2)] + [len({r[3] for r in of if r[2] == k}) for k in (3, 4)]
        expected.append((doc, len({r[:2] for r in of if r[1] is not None}), *told))
    assert sorted(map(tuple, got.collect())) == sorted(expected)


@pytest.mark.parametrize("shipped", [1, 1000])
def test_counts_of_documents_are_those_of_their_fields_read_one_by_one(spark, monkeypatch, shipped):
    """Names and values that are shipped and others, types that rows name and others, no type, several items of a type, nulls."""
    monkeypatch.setattr(normalize, "SHIPPED", shipped)
    rng = random.Random(6)
    names = [("规格", "width", "number", ["D"]), ("规格", "size", "enum", ["P", "Q"]), ("泵流量", "flow", "number", None), ("材料", "material", "enum", ["common"]), ("备用", "spare", "text", ["Q"])]
    aliases = [("size", "5", 1, ["Q"]), ("size", "5", 2, ["P"]), ("size", "7", 3, None), ("material", "pe", 4, ["D"]), ("material", "pe", 5, ["R"])]
    fields = [(rng.choice([1, 2, 3, 4, None]), rng.choice([1, 2, 3, 4, None]), rng.choice(["规格", "规格2", "泵流量", "材料", "备用", "泵x", "怪", None]), rng.choice(["5", "7", "PE/5", "9mm", None])) for _ in range(300)]
    items = [(rng.choice([1, 2, 3, 5, None]), rng.choice([1, 2, 3, None]), rng.choice(["d", "p", "q", "r", "s", None]), "n") for _ in range(14)]
    f = spark.createDataFrame(fields, "doc int, item int, name string, value string")
    i = spark.createDataFrame(items, "doc int, item int, hint string, name string")
    types = spark.createDataFrame([(t, t.upper()) for t in "dpqrs"], "alias string, product_type string")
    n = spark.createDataFrame(names, "alias string, term_type string, value_kind string, products array<string>")
    a = spark.createDataFrame(aliases, "term_type string, alias string, term_id int, products array<string>")
    redirects = spark.createDataFrame([("泵", "P")], "word string, product_type string")
    route = normalize.routed(i, types)
    said = normalize.matched(normalize.rewritten(normalize.redirected(f.where("name is not null"), route, redirects), n), n, a).collect()
    got = {r.doc: r for r in normalize.normalized(f, i, types, n, a, ("合同号",), redirects).collect() if r.doc}
    assert set(got) == {doc for doc, *_ in items if doc}
    for doc, r in got.items():
        own = [x for x in said if x.doc == doc]
        slots = {(x.item, x.term_type, x["index"]) for x in own if x.term_type}
        of = [{(x.item, x.term_type, x["index"], x.text) for x in own if x.kind == k} for k in ("term", "number")]
        new = [{x.text for x in own if x.kind == k} for k in ("value_candidate", "name_candidate")]
        assert (r.fields or 0, r.terms or 0, r.numbers or 0, r.value_candidates, r.name_candidates) == (len(slots), *map(len, of), *map(len, new))


def test_fields_are_not_written_or_met_one_by_one(spark, monkeypatch):
    """3000 fields of two contents: no table that is written has a row for each, and they are shuffled by document without names and values."""
    rows = {}
    written = normalize.written
    monkeypatch.setattr(normalize, "written", lambda df, name: rows.setdefault((name, len(rows)), written(df, name)))
    f = spark.range(3000).select((F.col("id") % 50).alias("doc"), F.lit(1).alias("item"), F.concat(F.lit("n"), (F.col("id") % 2).cast("string")).alias("name"), F.lit("5").alias("value"))
    items = spark.range(50).select(F.col("id").alias("doc"), F.lit(1).alias("item"), F.lit("d").alias("hint"), F.lit("x").alias("name"))
    types = spark.createDataFrame([("d", "D")], "alias string, product_type string")
    names = spark.createDataFrame([("n0", "t", "number", ["D"]), ("n1", "u", "text", ["E"])], "alias string, term_type string, value_kind string, products array<string>")
    aliases = spark.createDataFrame([], "term_type string, alias string, term_id int")
    got = normalize.normalized(f, items, types, names, aliases, ("c",), spark.createDataFrame([("n1", "E")], "word string, product_type string"))
    assert {(r.fields, r.numbers) for r in got.collect()} == {(1, 1), (1, 0)} and max(df.count() for df in rows.values()) <= 50
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(doc" in plan and "Exchange hashpartitioning(name" not in plan and "Exchange hashpartitioning(coalesce(value" not in plan
