"""Extracted fields of documents through the dictionary and back: route, redirect, rewrite, match by product type, merge, gather.

Every stage is a DataFrame with a row for each field or value; nothing is looked up row by row.  A field's items are told by (doc, item).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numbers, text
from tessera.operators import dictionary, residues
from tessera.operators.aliases import containing
from tessera.session import written


def routed(items: DataFrame, types: DataFrame) -> DataFrame:
    """(doc, item, product_type) of items (doc, item, hint, name): by the hint, else by the longest type alias in the name."""
    keyed = items.select(F.struct("doc", "item").alias("item_id"), "hint", "name")
    return dictionary.route_by_hint(keyed, written(types, "types")).select("item_id.doc", "item_id.item", "product_type").groupBy("doc", "item").agg(F.min("product_type").alias("product_type"))


#: Product types that say nothing: of a row that applies to all, and of an item that any row applies to.
COMMON, UNKNOWN = "common", "unknown"


def _held(df: DataFrame, name: str, default: Column) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, default)


def preferred(hits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of hits with the same ``by``, those whose `products` hold their `product_type`; all of them where none does.

    A row without products or with the common one applies to all types, and all rows apply to an unknown type.
    """
    none = F.array().cast("array<string>")
    products, own = F.coalesce("products", none), F.col("product_type")
    applies = (F.size(products) == 0) | F.array_contains(products, COMMON) | own.isNull() | (own == UNKNOWN) | F.coalesce(F.array_contains(products, own), F.lit(False))
    judged = hits.withColumn("__applies", applies)
    return judged.withColumn("__some", F.max("__applies").over(Window.partitionBy(*by))).where("__applies or not __some").drop("__applies", "__some")


def _hints(names: DataFrame, redirects: DataFrame) -> DataFrame:
    """(name, hint): the product type of the longest of the ``redirects`` (word, product_type) in each different name that holds one."""
    known = names.select("name").where("name is not null").distinct()
    return containing(known, redirects.select("word", "product_type"), "name", "word").groupBy("name").agg(F.max_by("product_type", F.struct(F.length("word"), "word")).alias("hint"))


#: Rows that one task sorts by document.
SORTED = 1 << 20


def _typed(rows: DataFrame, route: DataFrame, n: int, hints: DataFrame, by: str) -> DataFrame:
    """About ``n`` rows (doc, item, ...) with the product_type of their item, or of their hint, at the first item of that type in the document, if there is one.

    Rows and items are shuffled together, once, by document, and stay so; more rows make more tasks, so that none sorts more than it holds in memory.  Only
    then do rows get their ``hints``, which have a hint and perhaps more for each value of the column ``by``.
    """
    items = route.select("doc", "item", "product_type").withColumn("__is_item", F.lit(True))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // SORTED))
    every = rows.withColumn("__is_item", F.lit(False)).unionByName(items, allowMissingColumns=True).repartition(tasks, "doc").join(hints, by, "left")
    known = F.col("doc").isNotNull() & F.col("item").isNotNull()
    target = F.min(F.when(F.col("__is_item") & known, F.col("item"))).over(Window.partitionBy("doc", F.coalesce("product_type", "hint")))
    own = F.when(known, F.max("product_type").over(Window.partitionBy("doc", "item")))
    told = every.withColumn("__target", F.when(F.col("hint").isNotNull(), target)).withColumn("product_type", own).where("not __is_item")
    moves = F.col("__target").isNotNull() & ~F.col("hint").eqNullSafe(F.col("product_type"))
    kind = F.coalesce(F.when(moves, F.col("hint")).otherwise(F.col("product_type")), F.lit(UNKNOWN))
    return told.withColumns({"item": F.when(moves, F.col("__target")).otherwise(F.col("item")), "product_type": kind}).drop("hint", "__target", "__is_item")


def redirected(fields: DataFrame, route: DataFrame, redirects: DataFrame) -> DataFrame:
    """Fields (doc, item, name, value) of routed items with product_type, where names that point to another type have moved.

    A name points to the type of the longest of the ``redirects`` (word, product_type) in it.  If that is not its item's type and the document has items of
    it, the field belongs to the first of these; else it stays.  Each different name is searched once.
    """
    return _typed(fields, route, fields.count(), _hints(fields, redirects), "name").select("doc", "item", "name", "value", "product_type")


def rewritten(fields: DataFrame, names: DataFrame) -> DataFrame:
    """Fields (doc, item, name, value, perhaps product_type) with index and one row for each selected option.

    A number at the end of a name becomes its index where the rest is a known name and the whole is none; of a value with option marks only what
    is selected stays.  names: (alias, ...).
    """
    fields = _held(fields, "product_type", F.lit(UNKNOWN))
    known = names.select(text.normalize(F.col("alias")).alias("__key")).distinct()
    split = fields.withColumn("__p", numbers.index_suffix(F.col("name")))
    split = split.withColumn("__whole", text.normalize(F.col("name"))).withColumn("__base", text.normalize(F.col("__p.base")))
    split = split.join(known.select(F.col("__key").alias("__whole"), F.lit(True).alias("__is_whole")), "__whole", "left").join(known.select(F.col("__key").alias("__base"), F.lit(True).alias("__is_base")), "__base", "left")
    indexed = F.col("__is_whole").isNull() & F.col("__is_base")
    named = split.select("doc", "item", "product_type", F.when(indexed, F.col("__p.base")).otherwise(F.col("name")).alias("name"), F.when(indexed, F.col("__p.number")).alias("index"), "value")
    options = text.options(F.col("value"))
    chosen = F.transform(F.filter(options, lambda o: o["selected"]), lambda o: o["label"])
    return named.select("doc", "item", "product_type", "name", "index", F.explode(F.when(F.size(options) > 0, chosen).otherwise(F.array("value"))).alias("value"))


def matched(fields: DataFrame, names: DataFrame, aliases: DataFrame, prefixes: Sequence[str] = ()) -> DataFrame:
    """(doc, item, product_type, term_type, index, kind, result, text): what each field says.

    kind: 'number' (text is the number with its unit), 'term' (text is the term's id), 'value_candidate', 'name_candidate', 'text'.  Lists of values are
    taken apart; pieces that only wrap something are dropped, and what a piece says about another term type is a candidate of that type.
    names: (alias, term_type, value_kind, perhaps products); aliases: (term_type, alias, term_id, perhaps products).  A name or alias with several
    rows is read by those that apply to the field's product type, if any does, else by all.
    """
    fields = _held(fields, "product_type", F.lit(UNKNOWN))
    some = F.array().cast("array<string>")
    known = _held(names, "products", some).select(text.normalize(F.col("alias")).alias("__key"), "term_type", "value_kind", "products").distinct()
    keyed = fields.withColumn("__key", text.normalize(F.col("name")))
    asked = keyed.select("__key", "product_type").distinct().join(known, "__key")
    read = preferred(asked, ["__key", "product_type"]).select("__key", "product_type", "term_type", "value_kind").distinct()
    keyed = keyed.join(read, ["__key", "product_type"], "left")
    columns = ["doc", "item", "product_type", "term_type", "index"]
    unknown = keyed.where("term_type is null").select(*columns, F.lit("name_candidate").alias("kind"), F.col("__key").alias("text"))
    of_number = keyed.where("value_kind = 'number'").withColumn("p", numbers.number_unit(F.coalesce("value", F.lit("")), ()))
    number = of_number.select(*columns, F.when(F.col("p.kind") == "none", "text").otherwise("number").alias("kind"), F.when(F.col("p.kind") == "none", F.col("value")).otherwise(F.concat_ws(" ", F.concat_ws("-", "p.first", "p.second"), "p.unit")).alias("text"))
    free = keyed.where("value_kind not in ('number', 'enum')").select(*columns, F.lit("text").alias("kind"), F.col("value").alias("text"))
    parts = keyed.where("value_kind = 'enum'").select(*columns, F.explode(F.array_distinct(F.concat(F.array(text.normalize(F.col("value"))), text.tokens(F.col("value"))))).alias("alias"), text.normalize(F.col("value")).alias("__whole"))
    terms = _held(aliases, "products", some).select("term_type", text.normalize(F.col("alias")).alias("alias"), "term_id", "products").distinct()
    meant = parts.select("term_type", "alias", "product_type").distinct().join(terms, ["term_type", "alias"])
    terms = preferred(meant, ["term_type", "alias", "product_type"]).groupBy("term_type", "alias", "product_type").agg(F.min("term_id").alias("term_id"))
    hit = parts.join(terms, ["term_type", "alias", "product_type"], "left")
    # the whole value, where it is a term, speaks for its parts
    keys = [*columns, "__whole"]
    whole = hit.where("alias = __whole and term_id is not null").select(*[F.col(c).alias(f"of_{c}") for c in keys], F.lit(True).alias("__done")).distinct()
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys])
    left = hit.join(whole, same, "left").select(*columns, "alias", "term_id", "__whole", "__done").where("__done is null or alias = __whole")
    several = F.size(text.tokens(F.col("__whole"))) > 1
    kept = left.where(F.col("__done").isNotNull() | (F.col("alias") != F.col("__whole")) | ~several)
    judged = kept.withColumn("__fate", residues.fates(F.col("term_type"), F.col("alias"), prefixes))
    new = F.col("term_id").isNull()
    value = judged.where(~new | (F.col("__fate.action") == "candidate")).select(*columns, F.when(new, "value_candidate").otherwise("term").alias("kind"), F.coalesce(F.col("term_id").cast("string"), "alias").alias("text"))
    moved = judged.where(new & (F.col("__fate.action") == "reroute")).select(*columns, F.explode("__fate.targets").alias("t"))
    moved = moved.select("doc", "item", "product_type", F.col("t.term_type").alias("term_type"), "index", F.lit("value_candidate").alias("kind"), text.normalize(F.col("t.value")).alias("text"))
    return unknown.unionByName(number).unionByName(free).unionByName(value).unionByName(moved)


#: Kinds that are counted, by number; others are 0.
COUNTED = ("term", "number", "value_candidate", "name_candidate")


def _numbered(df: DataFrame, columns: Sequence[str], name: str) -> tuple[DataFrame, Column]:
    """Different values of some columns (as __name_column) with a number under ``name``, and the condition that joins them to rows that have them."""
    told = written(df.select(*columns).distinct().withColumn(name, F.monotonically_increasing_id()), name)
    return told.withColumnsRenamed({c: f"__{name}_{c}" for c in columns}), reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{name}_{c}")) for c in columns])


def _coded(read: DataFrame) -> DataFrame:
    """What combinations say with numbers in place of texts: slot for (term_type, index), null without a term type, kind, and what for (kind, text)."""
    kind = reduce(lambda found, i: F.when(F.col("kind") == COUNTED[i], F.lit(i + 1)).otherwise(found), range(len(COUNTED)), F.lit(0)).cast("tinyint").alias("kind")
    coded = read.join(*_numbered(read, ["term_type", "index"], "slot")).join(*_numbered(read, ["kind", "text"], "what"))
    return written(coded.select("__name", "__value", "__type", F.when(F.col("term_type").isNotNull(), F.col("slot")).alias("slot"), kind, "what"), "coded")


def _gathered(said: DataFrame) -> DataFrame:
    """(doc, fields, terms, numbers, value_candidates, name_candidates) from what fields say (doc, item, slot, kind, what).

    Rows are shuffled once, by document; counts are of rows that differ from the one before in the order of (item, slot, what), for candidates of what.
    """
    before = lambda w, *columns: reduce(lambda x, y: x & y, [F.lag(c).over(w).eqNullSafe(F.col(c)) for c in columns])
    by_slot, by_what = Window.partitionBy("doc").orderBy("item", "slot", "what"), Window.partitionBy("doc").orderBy("what")
    told = said.withColumn("__slot", F.col("slot").isNotNull() & ~before(by_slot, "item", "slot")).withColumn("__what", ~before(by_slot, "item", "slot", "what"))
    told = told.select("doc", "kind", "what", "__slot", "__what").withColumn("__new", ~before(by_what, "what"))
    of = lambda k, first: F.count_if((F.col("kind") == k) & F.col(first)).alias(f"{COUNTED[k - 1]}s")
    return told.groupBy("doc").agg(F.count_if("__slot").alias("fields"), of(1, "__what"), of(2, "__what"), of(3, "__new"), of(4, "__new"))


#: A product type that no row of a dictionary applies to, in place of all of these.
OTHER = "\0"

#: Names with values, the most frequent ones, that tasks hold with what they say.
SHIPPED = 4096


def _told(pairs: DataFrame, names: DataFrame, aliases: DataFrame, readers: Sequence[str]) -> DataFrame:
    """(name, value, slot, kind, what, readers): what names with values say, as numbers, to fields of which product types; null to those of all.

    Each is read once by each of the product types ``readers``; what it says to several is one row.
    """
    asked = pairs.select(F.col("name").alias("doc"), F.col("value").alias("item"), "name", "value", F.explode(F.array(*[F.lit(r) for r in readers])).alias("product_type"))
    read = matched(rewritten(written(asked, "pairs"), names), names, aliases).withColumnsRenamed({"doc": "__name", "item": "__value", "product_type": "__type"}).distinct()
    by = _coded(written(read, "read")).groupBy(F.col("__name").alias("name"), F.col("__value").alias("value"), "slot", "kind", "what").agg(F.array_sort(F.collect_set("__type")).alias("readers"))
    return by.withColumn("readers", F.when(F.size("readers") < len(readers), F.col("readers")))


def _say(fields: DataFrame, told: DataFrame, pairs: DataFrame) -> DataFrame:
    """Fields (doc, item, name, value) with what they say; the most frequent names with values are met in place, only fields with others may be shuffled for it."""
    same = lambda a, b: (a["name"] == b["name"]) & a["value"].eqNullSafe(b["value"])
    rest = [c for c in told.columns if c not in ("name", "value")]
    met = lambda f, t: f.join(t, same(f, t)).select(f["doc"], f["item"], *[t[c] for c in rest])
    often = written(pairs.orderBy(F.desc("n"), "name", "value").limit(SHIPPED).select("name", "value"), "often")
    split = lambda df, how: df.join(F.broadcast(often), same(df, often), how)
    frequent = met(fields, F.broadcast(written(split(told, "left_semi"), "frequent")))
    return frequent.unionByName(met(split(fields, "left_anti"), written(split(told, "left_anti"), "rare")))


def normalized(fields: DataFrame, items: DataFrame, types: DataFrame, names: DataFrame, aliases: DataFrame, document_names: Sequence[str], redirects: DataFrame | None = None) -> DataFrame:
    """(doc, items, fields, terms, numbers, value_candidates, name_candidates, info, product_types) for each document.

    Fields named as in ``document_names`` belong to the document, not to an item; others first go to the item that their name points to (``redirects``:
    word, product_type).  Names and values are read by the type of their item.  Fields of one item, term type and index are one; equal values of it
    count once.
    """
    # the cheap test first: most names hold none of these
    belongs = F.coalesce(reduce(lambda x, y: x | y, [F.contains("name", F.lit(d)) & (text.trim(F.col("name")) == d) for d in document_names], F.lit(False)), F.lit(False))
    info = fields.where(belongs).groupBy("doc").agg(F.min("value").alias("info"))
    route = written(routed(items, types), "routes")
    own = fields.where(~belongs & F.col("name").isNotNull())
    # names with their values repeat over documents: each is read once, by all product types that decide, before its fields meet their items
    pairs = written(own.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")), "counted")
    applied = reduce(DataFrame.unionByName, [_held(df, "products", F.array().cast("array<string>")).select(F.explode("products").alias("p")) for df in (names, aliases)])
    readers = sorted({r.p for r in applied.distinct().collect() if r.p and r.p != COMMON} | {UNKNOWN, OTHER})  # as many as product types are named in the dictionary
    told = _told(pairs, names, aliases, readers)
    told = told.withColumn("hint", F.lit(None).cast("string")) if redirects is None else told.join(_hints(pairs, redirects), "name", "left")
    told = written(told, "told")
    # fields are shuffled with two numbers: the first for all that does not differ from value to value
    common = ["hint", "readers", "slot", "kind"]
    shapes, same = _numbered(told, common, "shape")
    told = written(told.join(shapes, same).select("name", "value", "shape", "what"), "numbers")
    shapes = shapes.withColumnsRenamed({f"__shape_{c}": c for c in common})
    said = _typed(_say(own, told, pairs), route, pairs.agg(F.sum("n")).first()[0] or 0, shapes, "shape")
    reader = F.when(F.col("product_type").isin(*readers), F.col("product_type")).otherwise(OTHER)
    gathered = _gathered(said.where(F.col("readers").isNull() | F.array_contains("readers", reader)).select("doc", "item", "slot", "kind", "what"))
    zero = {k: F.coalesce(k, F.lit(0)).cast("long") for k in ("value_candidates", "name_candidates")}
    by_doc = route.groupBy("doc").agg(F.count(F.lit(1)).alias("items"), F.array_sort(F.collect_set("product_type")).alias("product_types"))
    return by_doc.join(gathered, "doc", "left").join(info, "doc", "left").withColumns(zero)
