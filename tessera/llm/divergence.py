"""Source divergence audit: how far apart the sources of a language are in their terms, and which terms set a source apart.

Terms are counted in tasks, then by Spark.  The kept terms of a language are numbered in slices of bounded width; a group (language, source) has one compressed
vector for each slice.  Groups take seats in blocks, and each block stays where it is (a cached, hash-partitioned table) while the vectors of its peers come
to it in the rounds of a tournament: in round r blocks i and j with i + j = r modulo their number meet, so every two blocks meet once, and so
does each block with itself.  A meeting evaluates all its pairs of groups for both of them.  The vector of the language visits every block once; a heap for each group
keeps its leading terms.  Only sums and leading terms leave the blocks.

All numbers are integers: p = 1 + floor(PARTS * (count + 5) / (N + 5 * V)) for each kept term, whether the group has it or not.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, pick, prepare

#: Terms of a slice and groups of a block: a meeting holds at most 2 * SEATS * SLICE numbers.
SLICE, SEATS = 16384, 8
#: Different terms that a task gathers before it hands its counts on, and bytes of a text split at once.
ENTRIES, PIECE = 200_000, 1 << 20
PARTS, SMOOTH = 1_000_000_000, 5
#: Bytes of terms: A-Z become a-z, other ASCII bytes separate; all bytes of other characters belong to terms.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"


def pieces(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    data = text.encode().translate(BYTES)
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; a row with a null term counts the documents of the group."""
    prepare(docs.sparkSession)
    rows = pick(docs, "text", "lang", "source")
    rows = rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])

    def handed(found: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            terms = [None, *n]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array([t and t.decode() for t in terms], pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        found.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        entries = 0
        for b in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in b.columns)):
                n, docs = found.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for terms in pieces(text):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
                docs[None] += 1
                entries += len(n) - before
            if entries > ENTRIES:
                yield from handed(found)
                entries = 0
        yield from handed(found)

    parts = rows.mapInArrow(run, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p of each count, exactly; Python's integers where 64 bits could overflow."""
    below = total + SMOOTH * terms
    if not below:
        return np.zeros(len(counts), np.int64)
    kind = np.int64 if below < 2**63 // (2 * PARTS) else object
    return (1 + PARTS * (counts.astype(kind) + SMOOTH) // below).astype(np.int64)


def packed(places: np.ndarray, values: np.ndarray) -> bytes:
    """Ascending places and their values, compressed."""
    return zlib.compress(np.diff(places, prepend=0).astype(np.uint32).tobytes() + values.astype(np.int64).tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, np.uint32, n), dtype=np.int64), np.frombuffer(raw, np.int64, n, 4 * n)


def dense(rows: pa.Table) -> np.ndarray:
    """A line of p for each vector (width, rest, packed); terms that a group lacks have its `rest`."""
    out = np.empty((rows.num_rows, rows["width"][0].as_py() if rows.num_rows else 0), np.int64)
    for line, rest, data in zip(out, rows["rest"].to_pylist(), rows["packed"].to_pylist()):
        line[:] = rest
        places, values = unpacked(data)
        line[places] = values
    return out


def _packs(rows: DataFrame, schema: str, extra: tuple[str, ...]) -> DataFrame:
    """Rows (.., width, total, kept, list of (place, n)) with p of the listed terms packed and that of the others as `rest`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest, data = [], []
            for total, kept, held in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("total", "kept")), b.column(b.schema.get_field_index("held"))):
                flat = held.values.flatten() if held.is_valid and len(held.values) else [pa.array([], pa.int64())] * 2
                places, n = (np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in flat)
                rest.append(int(shares(np.zeros(1, np.int64), total, kept)[0]))
                data.append(packed(places, shares(n, total, kept)))
            names = [*extra, "width"]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in names], pa.array(rest, pa.int64()), pa.array(data, pa.binary())], names=[*names, "rest", "packed"])

    return rows.mapInArrow(run, f"{schema}, width int, rest long, packed binary")


def vectors(counted: DataFrame, min_docs: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(lang, slice, block, blocks, source, width, rest, packed) of the groups, and (lang, slice, terms, width, rest, packed) of the languages."""
    words = counted.where("term is not null")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    kept = scratch.write(kept, "kept-terms")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    slices = max(1, -(-(sizes.agg(F.max("kept")).first()[0] or 0) // SLICE))
    kept = kept.withColumn("slice", F.pmod(F.xxhash64("lang", "term"), F.lit(slices)).cast("int"))
    kept = scratch.write(kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")).cast("long") - 1), "numbered-terms")
    listed = words.select("lang", "source", "term", "n").join(kept.select("lang", "term", "slice", "place"), ["lang", "term"])
    held = listed.groupBy("lang", "source", "slice").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("held"), F.sum("n").alias("slice_total"))
    held = scratch.write(held, "group-slices")
    groups = counted.where("term is null").select("lang", "source")
    totals = held.groupBy("lang", "source").agg(F.sum("slice_total").alias("total"))
    by_lang = Window.partitionBy("lang")
    seats = groups.join(totals, ["lang", "source"], "left").withColumn("block", F.floor((F.row_number().over(by_lang.orderBy("source")) - 1) / SEATS).cast("int")).withColumn("blocks", (F.max("block").over(by_lang) + 1).cast("int"))
    widths = kept.groupBy("lang", "slice").agg(F.count(F.lit(1)).cast("int").alias("width"))
    cells = seats.join(sizes, "lang", "left").join(widths, "lang", "left")
    cells = cells.select("lang", "source", "block", "blocks", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("slice", F.lit(0)).alias("slice"), F.coalesce("width", F.lit(0)).alias("width"))
    mine = _packs(cells.join(held.drop("slice_total"), ["lang", "source", "slice"], "left"), "lang string, slice int, block int, blocks int, source string", ("lang", "slice", "block", "blocks", "source"))
    whole = kept.groupBy("lang", "slice").agg(F.sort_array(F.collect_list(F.struct("place", "lang_n", "term"))).alias("all"), F.count(F.lit(1)).cast("int").alias("width")).join(sizes, "lang")
    whole = whole.select("lang", "slice", F.col("all.term").alias("terms"), "width", F.col("lang_total").alias("total"), "kept", F.transform("all", lambda x: F.struct(x.place, x.lang_n)).alias("held"))
    mine = scratch.write(mine, "group-vectors")
    whole = scratch.write(_packs(whole, "lang string, slice int, terms array<string>", ("lang", "slice", "terms")), "language-vectors")
    scratch.free("kept-terms", "group-slices", "numbered-terms")
    return mine, whole


def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
    """(lang, source, item, value): for each pair of different groups, here and visiting, their distance in this slice, for both of them."""
    lang, a_names, b_names = None, [], []
    at, items, values = [], [], []
    if mine.num_rows and theirs.num_rows:
        lang, a_names, b_names = mine["lang"][0].as_py(), mine["source"].to_pylist(), theirs["source"].to_pylist()
        home = mine["block"][0].as_py() == theirs["home"][0].as_py()
        a, b = dense(mine), dense(theirs)
        for i, name in enumerate(a_names):
            for j, other in enumerate(b_names):
                if not home or name < other:
                    value = int(np.abs(a[i] - b[j]).sum())
                    at += [name, other]
                    items += [other, name]
                    values += [value, value]
    return pa.table([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "item", "value"])


def leading(mine: pa.Table, whole: pa.Table, ranks: int) -> pa.Table:
    """(lang, source, item, value): the terms that a group has more of than its language does, the leading ``ranks`` of this slice."""
    names, items, values = [], [], []
    if mine.num_rows and whole.num_rows:
        q, terms = dense(whole)[0], whole["terms"][0].as_py()
        for name, data in zip(mine["source"].to_pylist(), mine["packed"].to_pylist()):
            places, p = unpacked(data)
            f = p - q[places]
            more = np.flatnonzero(f > 0)
            for less, place in heapq.nsmallest(ranks, zip((-f[more]).tolist(), places[more].tolist())):
                names.append(name)
                items.append(terms[place])
                values.append(-less)
    lang = mine["lang"][0].as_py() if mine.num_rows else None
    return pa.table([pa.array([lang] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "item", "value"])


def audit(docs: DataFrame, min_docs: int = 30, ranks: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks the other sources of the language by distance, part `term` a group's leading terms.

    Null texts, languages and sources count as empty ones; texts without terms still make their group.  A language that keeps no term has distances of 0, a
    source alone in its language no pairs.  Ties rank by item as UTF-8.  Rows that repeat count each; other columns are not read.  Empty tables
    give no rows.  Sums of distances must fit in a long, as they do up to nine thousand million kept terms.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    counted = scratch.write(count_terms(docs), "term-counts")
    mine, whole = vectors(counted, min_docs, scratch)
    scratch.free("term-counts")
    spot, schema = ["lang", "slice", "block"], "lang string, source string, item string, value long"
    seated = mine.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *spot).persist()
    path, rounds = scratch.fresh("meetings"), seated.agg(F.max("blocks")).first()[0] or 0
    scratch.keep("meetings", path)
    for r in range(rounds):
        partner = F.pmod(F.lit(r) - F.col("block"), F.col("blocks"))
        stay = seated.where((F.col("blocks") > r) & (partner >= F.col("block")))
        travel = mine.where((F.col("blocks") > r) & (partner <= F.col("block"))).select(F.col("lang").alias("lang"), F.col("slice").alias("slice"), partner.alias("block"), F.col("block").alias("home"), "source", "width", "rest", "packed")
        stay.groupBy(*spot).cogroup(travel.groupBy(*spot)).applyInArrow(meet, schema).write.mode("append").parquet(path)
    visits = whole.join(mine.select(*[F.col(c).alias(c) for c in spot]).distinct(), ["lang", "slice"])
    terms = scratch.write(seated.groupBy(*spot).cogroup(visits.groupBy(*spot)).applyInArrow(lambda a, b: leading(a, b, ranks), schema), "leading-terms")
    seated.unpersist()
    pairs = spark.read.schema(schema).parquet(path).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) if rounds else terms.limit(0)
    both = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    return both.withColumn("rank", F.row_number().over(order).cast("int")).where((F.col("part") == "pair") | (F.col("rank") <= ranks)).select("lang", "source", "part", "item", "value", "rank")
