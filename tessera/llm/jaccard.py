"""N-gram Jaccard join with PartEnum signatures.

Sets fall into bands of size, so narrow that similar sets lie in one band or in neighbouring ones.  For each pair of
neighbouring bands the Hamming distance of similar sets is at most k; the feature domain is split into n1 first-level
partitions of n2 second-level ones, and each way to leave out k2 of the n2 gives a signature: the features that
fall into the others.  As n1 * (k2 + 1) > k, two similar sets share a signature.  A set has signatures for its own band and
for the next.

Documents with equal sets are one node from the start.  A set travels as its sketch, some bits whose differences are a lower bound of
the Hamming distance; only sets of pairs that sketches leave are read.  The sets of one signature are compared first with its pivot, the
one that shares most with others, as an original does with its copies.  Each set tries the pivot that looks nearest, which makes components, then the others that
it is not connected with yet.  Only signatures whose sets are not all connected by then are looked at again: tasks hold blocks of
their sketches and let for each component the nearest pair out that may be similar, then all that are still unconnected.  Links are exact: shingle sets of both sides are intersected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import shingles
from tessera.llm.common import Scratch, prepare
from tessera.llm.components import components

#: Signatures that a task packs before it hands them on, and that it sorts at once.
PACK, SORT = 1 << 19, 1 << 19
#: Characters of text for each packed partition.
SPREAD = 1 << 23
#: Sketches of one signature that a task compares with as many others, and bytes of them that it compares with one at a time.
BLOCK, PIECE = 2048, 1 << 20


class PartEnum:
    """Signatures for a threshold num / den."""

    def __init__(self, num: int, den: int, n2: int, k2: int):
        self.num, self.den, self.n2, self.k2 = num, den, n2, k2
        self.tops: list[int] = []
        self.subsets = [list(c) for c in combinations(range(n2), n2 - k2)]

    def band(self, size: int) -> int:
        """The number of the band that holds sets of this size; tops[i] is the largest size of band i."""
        while not self.tops or self.tops[-1] < size:
            self.tops.append(((self.tops[-1] + 1 if self.tops else 1) * self.den) // self.num)
        return int(np.searchsorted(self.tops, size))

    def distance(self, band: int) -> int:
        """The largest Hamming distance of similar sets in this band and the one before."""
        self.band(self.tops[-1] + 1) if band >= len(self.tops) else None
        return 2 * self.tops[band] * (self.den - self.num) // (self.den + self.num)

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Of one set, given as sorted 64-bit hashes."""
        own, out = self.band(len(s)), []
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(shingles.mix(s ^ np.uint64(0x2545F4914F6CDD1D)))))
        for band in (own, own + 1):
            k = self.distance(band)
            n1 = -(-(k + 1) // (self.k2 + 1)) if k else 1
            n2, subsets = (self.n2, self.subsets) if k else (1, [[0]])
            cells = n1 * n2
            cell = ((s >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
            bounds = np.searchsorted(cell, np.arange(cells + 1, dtype=np.uint64))
            sums = (total[bounds[1:]] - total[bounds[:-1]]).reshape(n1, n2)
            for j, subset in enumerate(subsets):
                label = np.arange(n1, dtype=np.uint64) * np.uint64(64) + np.uint64(j) + np.uint64((band + 1) << 40)
                out.append(shingles.mix(sums[:, subset].sum(axis=1, dtype=np.uint64) ^ shingles.mix(label)))
        return np.concatenate(out)


def _packed(docs: DataFrame, words: int, enum: PartEnum, parts: int) -> DataFrame:
    """Rows of two kinds: (doc_id, key, set_id, n, sketch) for each document, and packs of (signature, set_id) for each partition p.

    A task gives the sketch of a set once, and again only where it saw too many sets to remember.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["p", "doc_id", "key", "set_id", "n", "sketch", "pack"]

        def out(p: np.ndarray, ids: pa.Array, keys: pa.Array, sets: np.ndarray, n: np.ndarray, sketches: list, packs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), ids, keys, pa.array(sets, pa.int64()), pa.array(n, pa.int64()), pa.array(sketches, pa.binary()), pa.array(packs, pa.binary())], names=names)

        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            sig = np.concatenate([h[0] for h in held])
            own = np.concatenate([h[1] for h in held])
            p = ((sig >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(p, kind="stable")
            sig, own, p = sig[order], own[order], p[order]
            at = np.flatnonzero(np.diff(p, prepend=np.uint64(parts)))
            both = np.stack((sig, own.view(np.uint64)), axis=1)
            packs = [both[a:b].tobytes() for a, b in zip(at, [*at[1:], len(p)])]
            nothing, nulls = np.zeros(len(at), np.int64), pa.nulls(len(at), pa.int64())
            return out(p[at].astype(np.int32), nulls, nulls, nothing, nothing, [None] * len(at), packs)

        held, count, seen = [], 0, set()
        for b in batches:
            ids, sizes, sketches = [], [], []
            for s in shingles.sets(b.column(1), words):
                sizes.append(len(s))
                ids.append(shingles.set_id(s) if len(s) else 0)
                sketches.append(None)
                if len(s) and ids[-1] not in seen:  # a copy adds nothing
                    seen.add(ids[-1])
                    sketches[-1] = sketch(s).tobytes()
                    sig = enum.signatures(s)
                    held.append((sig, np.full(len(sig), ids[-1], np.int64)))
                    count += len(sig)
                if count >= PACK:
                    yield flush(held)
                    held, count = [], 0
                    if len(seen) > PACK // 8:
                        seen = set()
            sets = np.array(ids, np.int64)
            yield out((sets.view(np.uint64) % np.uint64(parts)).astype(np.int32), b.column(0), b.column(2), sets, np.array(sizes, np.int64), sketches, [None] * len(ids))
        if held:
            yield flush(held)
        del held, seen
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text", "key").mapInArrow(run, "p int, doc_id long, key long, set_id long, n long, sketch binary, pack binary")


def _met(packs: list[bytes], carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of signatures with several sets as signature, set; one row for each signature)."""
    rows = np.concatenate([carried, *(np.frombuffer(x, np.uint64).reshape(-1, 2) for x in packs)])
    sets = rows[:, 1].view(np.int64) if rows.flags.c_contiguous else rows[:, 1].copy().view(np.int64)
    order = np.lexsort((sets, rows[:, 0]))
    sig, own = rows[order, 0], sets[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
    sig, own = sig[fresh], own[fresh]
    first = np.flatnonzero(np.diff(sig, prepend=~sig[:1]))
    size = np.diff(np.append(first, len(sig)))
    shared = np.repeat(size > 1, size)
    return np.stack((sig[shared].view(np.int64), own[shared]), axis=1), np.stack((sig[first], own[first].view(np.uint64)), axis=1)


def _unpacked(packed: DataFrame) -> DataFrame:
    """(kind, doc_id, key, set_id, n, sketch, sig): documents as they are, and the sets of every signature that several have.

    A task sorts a bounded number of signatures at once and carries one row for each signature on, so that a
    frequent one needs no more memory than others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "key", "set_id", "n", "sketch", "sig"]
        none = np.zeros((0, 2), np.uint64)

        def met(packs: list[bytes], carried: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
            rows, carried = _met(packs, carried)
            m = len(rows)
            columns = [pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(rows[:, 1]), pa.array(np.zeros(m, np.int64)), pa.nulls(m, pa.binary()), pa.array(rows[:, 0])]
            return pa.RecordBatch.from_arrays(columns, names=names), carried

        packs, count, carried, p = [], 0, none, None
        for b in batches:
            docs = b.filter(b.column(6).is_null())
            zero = pa.array(np.zeros(docs.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(docs.num_rows, np.int32)), docs.column(1), docs.column(2), docs.column(3), docs.column(4), docs.column(5), zero], names=names)
            rest = b.filter(b.column(6).is_valid())
            for q, pack in zip(rest.column(0).to_pylist(), rest.column(6).to_pylist()):
                if (q != p or count >= SORT) and packs:
                    got, carried = met(packs, carried)
                    yield got
                    packs, count = [], 0
                if q != p:
                    carried, p = none, q
                packs.append(pack)
                count += len(pack) // 16
        if packs:
            yield met(packs, carried)[0]
        del packs, carried
        pa.default_memory_pool().release_unused()

    rows = packed.repartition("p").sortWithinPartitions("p")
    return rows.mapInArrow(run, "kind int, doc_id long, key long, set_id long, n long, sketch binary, sig long")


def sketch(s: np.ndarray) -> np.ndarray:
    """Bits of a set as bytes: whether the number of its features in each cell of the feature domain is odd.

    Each bit that differs between two sets takes a feature that only one of them has.  The number of cells is a power of two, at
    least 64 and twice the size of the set.
    """
    cells = 1 << max(6, (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1)


def folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Rows of sketches as rows of ``width`` bytes: what fewer cells give."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, width), axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), -1)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits differ between rows of bytes, each of whole words of 64 bits."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(-1, dtype=np.int64)


def apart_from(sketches: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
    """How many bits differ between sketch i and each of the sketches j, a few of which are held at a time."""
    step = max(1, PIECE // sketches.shape[1])
    out = np.empty(len(j), np.int64)
    for at in range(0, len(j), step):
        out[at : at + step] = apart(sketches[j[at : at + step]], sketches[i])
    return out


def gathered(column: pa.ChunkedArray) -> np.ndarray:
    """Sketches of several widths as rows of the least of these, a chunk at a time."""
    wide = [pc.binary_length(c).to_numpy() for c in column.chunks]
    out = np.zeros((len(column), min(int(w.min()) for w in wide if len(w))), np.uint8)
    start = 0
    for chunk, w in zip(column.chunks, wide):
        for x in np.unique(w).tolist():
            at = np.flatnonzero(w == x)
            out[start + at] = folded(matrix(chunk.take(pa.array(at))), out.shape[1])
        start += len(chunk)
    return out


def _sets_of(docs: DataFrame, words: int) -> DataFrame:
    """(set_id, s) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [s for s in shingles.sets(b.column(0), words) if len(s)]
            ids = pa.array([shingles.set_id(s) for s in found], pa.int64())
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int32)
            values = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["set_id", "s"])

    return docs.select("text").mapInArrow(run, "set_id long, s array<long>")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents with a key for each row, a hash of id and text, which null ids have as well; only rows that repeat both share it."""
    return docs.withColumn("key", F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")))


def _one_each(docs: DataFrame, wanted: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The documents with the keys of ``wanted`` (key, many); of those with ``many`` one row a key, the least.

    The keys are written, so that Spark knows their size and broadcasts them only where it is small.
    """
    wanted = scratch.write(wanted, name)
    if wanted.where("many").isEmpty():
        return docs.join(wanted, "key", "left_semi")
    rest = [c for c in docs.columns if c != "key"]
    single = docs.join(wanted.where("not many"), "key", "left_semi")
    least = docs.join(wanted.where("many"), "key", "left_semi").groupBy("key").agg(F.min(F.struct(*rest)).alias("least"))
    return single.select("key", *rest).unionByName(least.select("key", "least.*"))


def _possible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, gap): those of ``pairs`` (a, b) that the sketches of their sets do not rule out, and the share of both that differs at least."""
    a, b = (sets.select(F.col("set_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in filter(len, batches):
            both = rows.column(2).to_numpy() + rows.column(3).to_numpy()
            least = np.zeros(len(both), np.int64)
            wide = [pc.binary_length(rows.column(i)).to_numpy() for i in (4, 5)]
            for x, y in np.unique(np.stack(wide, axis=1), axis=0).tolist():
                at = np.flatnonzero((wide[0] == x) & (wide[1] == y))
                ka, kb = (folded(matrix(rows.column(i).take(pa.array(at))), min(x, y)) for i in (4, 5))
                least[at] = apart(ka, kb)
            kept = pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(least / both)], names=["a", "b", "gap"])
            yield kept.filter(pa.array(least * (den + num) <= (den - num) * both))

    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ka", "kb")
    return joined.mapInArrow(run, "a long, b long, gap double")


def _links(pairs: DataFrame, docs: DataFrame, holders: DataFrame, words: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar; only their sets are read, each from one row.  holders: (set_id, doc_id, key, many)."""
    needed = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    sets = _sets_of(_one_each(docs, holders.join(needed, "set_id", "left_semi").select("key", "many"), scratch, "wanted"), words)
    a, b = (sets.select(F.col("set_id").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    common, sizes = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    return scratch.write(pairs.join(a, "a").join(b, "b").where(F.lit(den) * common >= F.lit(num) * (sizes - common)).select("a", "b"), "links")


def _weighed(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(sig, set_id, n, w): the members of each signature with their weights, the sums of the sizes of their signatures.  sets: (set_id, n, ...)."""
    crowd = members.groupBy("sig").agg(F.count(F.lit(1)).alias("m"))
    weight = members.join(crowd, "sig").groupBy("set_id").agg(F.sum("m").alias("w"))
    return members.join(weight.join(sets.select("set_id", "n"), "set_id"), "set_id").select("sig", "set_id", "n", "w")


def _with_pivots(opened: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): each set of a signature with its heaviest one, where their sizes allow a link."""
    pivot = opened.groupBy("sig").agg(F.min(F.struct((-F.col("w")).alias("w"), "set_id", "n")).alias("p")).select("sig", F.col("p.set_id").alias("a"), F.col("p.n").alias("na"))
    fits = F.lit(den) * F.least("n", "na") >= F.lit(num) * F.greatest("n", "na")
    return opened.join(pivot, "sig").where(fits & (F.col("set_id") != F.col("a"))).select(F.least("a", "set_id").alias("a"), F.greatest("a", "set_id").alias("b")).distinct()


def _nearest(pairs: DataFrame) -> DataFrame:
    """(a, b): for each set that stands in pairs (a, b, gap) the one with the least gap."""
    ends = pairs.select(F.col("a").alias("end"), "a", "b", "gap").unionByName(pairs.select(F.col("b").alias("end"), "a", "b", "gap"))
    return ends.groupBy("end").agg(F.min(F.struct("gap", "a", "b")).alias("x")).select("x.a", "x.b").distinct()


def _apart_still(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are not connected yet."""
    out = pairs.select("a", "b")
    for x in "ab":
        out = out.join(labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")), x, "left")
    return out.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the component of their set so far."""
    return rows.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))


def _mixed(rows: DataFrame) -> DataFrame:
    """(sig, m): the signatures whose sets are in several components, with the number of their sets."""
    return rows.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("m")).where("x <> y").select("sig", "m")


def may_link(n: np.ndarray, label: np.ndarray, sketches: np.ndarray, side: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of a block in different components that the sketches do not rule out.

    side says on which side of the block a set stands: 0 and 1 meet, 2 meets all.
    """
    at_i, at_j = [], []
    for i in np.flatnonzero(side != 1):
        j = np.flatnonzero((label != label[i]) & ((side == 1) | ((side == 2) & (np.arange(len(n)) > i))) & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i])))
        if len(j):
            j = j[apart_from(sketches, i, j) * (den + num) <= (den - num) * (n[j] + n[i])]
            at_i.append(np.full(len(j), i))
            at_j.append(j)
    return (np.concatenate(at_i), np.concatenate(at_j)) if at_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def nearest_links(n: np.ndarray, label: np.ndarray, sketches: np.ndarray, side: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of ``may_link`` for each component the one whose sketches differ least for their sizes: no more pairs than components."""
    _, code = np.unique(label, return_inverse=True)
    best, at_i, at_j = np.full(code.max(initial=-1) + 1, np.inf), np.zeros(code.max(initial=-1) + 1, np.int64), np.zeros(code.max(initial=-1) + 1, np.int64)
    for i in np.flatnonzero(side != 1):
        j = np.flatnonzero((label != label[i]) & ((side == 1) | ((side == 2) & (np.arange(len(n)) > i))) & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i])))
        gap = apart_from(sketches, i, j) / (n[j] + n[i])
        near = gap * (den + num) <= (den - num) * (1 + 1e-12)
        j, gap = j[near], gap[near]
        if len(j):
            order = np.argsort(-gap, kind="stable")  # of several the least is written last
            j, gap = j[order], gap[order]
            if gap[-1] < best[code[i]]:
                best[code[i]], at_i[code[i]], at_j[code[i]] = gap[-1], i, j[-1]
            less = gap < best[code[j]]
            to = code[j[less]]
            best[to], at_i[to], at_j[to] = gap[less], i, j[less]
    found = np.unique(np.stack((at_i, at_j), axis=1)[best < np.inf], axis=0)
    return found[:, 0], found[:, 1]


def _near(mixed: DataFrame, num: int, den: int, nearest: bool) -> DataFrame:
    """(a, b): pairs of one signature in different components that may be similar, or for each component of it only the nearest.

    mixed: (sig, m, set_id, n, label, sketch).  A signature with more than BLOCK sets is split; each pair of its parts is a block of its own.
    """
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("set_id"), parts).cast("int")
    dealt = mixed.withColumn("c", own).withColumn("d", F.explode(F.sequence(F.lit(0), parts - 1)))
    side = F.when(F.col("c") == F.col("d"), 2).when(F.col("c") < F.col("d"), 0).otherwise(1)
    dealt = dealt.select("sig", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), "set_id", "n", "label", side.alias("side"), "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: pa.Table) -> pa.RecordBatch:
            ids, n, label, side = (rows[c].to_numpy() for c in ("set_id", "n", "label", "side"))
            i, j = (nearest_links if nearest else may_link)(n, label, gathered(rows["sketch"]), side, num, den)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["a", "b"])

        held: pa.Table | None = None  # the block that may go on in the next batch
        for b in batches:
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            keys = np.stack([rows[c].to_numpy() for c in ("sig", "i", "j")], axis=1)
            starts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)) if len(keys) else np.zeros(1, np.int64)
            for x, y in zip(starts[:-1].tolist(), starts[1:].tolist()):
                yield pairs(rows.slice(x, y - x))
            held = rows.slice(int(starts[-1]))
        if held is not None and held.num_rows:
            yield pairs(held)
        del held
        pa.default_memory_pool().release_unused()  # workers live on, and their memory counts

    return dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, words: int, num: int, den: int, n2: int | None, k2: int) -> tuple[DataFrame, DataFrame, Scratch]:
    """(doc_id, key, set_id, n) of each row of docs (doc_id, text, key); (set_id, doc_id, key, many, label) of each set; the tables these read.

    A set's row is that of the least doc_id, nulls last, then the least key; many says whether rows repeat it.
    """
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    n2 = n2 or (2 if num / den > 0.85 else 3)
    enum = PartEnum(num, den, n2, k2)
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, -(-chars // SPREAD))
    table = scratch.write(_unpacked(_packed(docs, words, enum, parts)), "signatures")
    own = scratch.write(table.where("kind = 0").select("doc_id", "key", "set_id", "n"), "own")
    kept = own.where("n > 0").groupBy("set_id", "doc_id", "key").agg(F.count(F.lit(1)).alias("m"))
    kept = kept.groupBy("set_id").agg(_first_row(F.col("m") > 1).alias("x"))
    holders = scratch.write(kept.select("set_id", "x.doc_id", "x.key", "x.many"), "holders")
    members = scratch.write(table.where("kind = 1").select("sig", "set_id").distinct(), "members")
    shared = table.where("kind = 0 and sketch is not null").join(members.select("set_id").distinct(), "set_id", "left_semi")
    sets = scratch.write(shared.groupBy("set_id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sets")
    scratch.free("signatures")
    opened = scratch.write(_weighed(members, sets), "open")
    scratch.free("members")
    first = scratch.write(_with_pivots(opened, num, den), "first")
    possible = scratch.write(_possible(first, sets, num, den), "possible")

    def connected(pairs: DataFrame, known: DataFrame | None) -> DataFrame:
        """(node, label) with the links among ``pairs``; what is connected already is stars, to which they are added."""
        links = _links(pairs, docs, holders, words, num, den, scratch)
        if known is not None:
            links = links.unionByName(known.select(F.col("node").alias("a"), F.col("label").alias("b")))
        return scratch.write(components(links, scratch), "labels")

    labels = connected(_nearest(possible), None)
    rest = scratch.write(_apart_still(possible, labels), "rest")
    if not rest.isEmpty():
        labels = connected(rest, labels)
    for nearest in (True, False):  # the nearest first: what they connect makes no more pairs
        rows = _labelled(opened.select("sig", "set_id"), labels)
        mixed = rows.join(_mixed(rows), "sig").join(sets, "set_id")
        rest = scratch.write(_near(mixed, num, den, nearest).distinct().join(first, ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            labels = connected(rest, labels)
    scratch.free("sets", "open", "first", "possible", "rest", "links", "wanted", "stars")
    least = holders.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    return own, least, scratch


def _first_row(many: Column) -> Column:
    """Of rows with doc_id and key, the one with the least doc_id, nulls last, then the least key, and its ``many``."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", many.alias("many")))


def join(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, n2: int | None = None, k2: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Two documents link when their sets of ``words``-word shingles have a Jaccard similarity of at least num / den; component_id is the
    least doc_id reachable by links, the own one included.  Null and empty texts have no shingles and no links; a text with fewer words is
    one shingle; repeated rows and ids give a row each.  A null doc_id links by its text; where a component has no other, component_id is null.
    An empty table gives no rows.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    own, least, _ = _grouped(_keyed(docs, "doc_id", "text"), words, num, den, n2, k2)
    by_label = least.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_set = least.join(by_label, "label").select("set_id", "component_id")
    full = own.where("n > 0").join(by_set, "set_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def survivors(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, n2: int | None = None, k2: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of ``join``: that of the least doc_id, nulls last, then the least hash of id and text.

    Of rows that repeat id and text the least stays.  Rows without shingles have no links, so all of them stay.
    """
    keyed = _keyed(docs, id_col, text_col)
    own, least, scratch = _grouped(keyed.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), "key"), words, num, den, n2, k2)
    first = least.groupBy("label").agg(_first_row(F.col("many")).alias("x")).select("x.key", "x.many")
    empty = own.where("n = 0").select("key", F.lit(False).alias("many")).distinct()
    kept = _one_each(keyed, first.unionByName(empty), scratch, "survivors")
    scratch.free("own", "holders", "labels")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
