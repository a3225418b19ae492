"""Removal of long repeated strings by bucket-pointer refinement.

Every string of ``length`` bytes contains an anchor: the q-gram with the least hash in it, at the same place wherever the string
stands.  Positions start in the bucket of their anchor's q-gram.  Neighbouring positions with one anchor form a block, and a
bucket is refined by the identifiers of the strings at later offsets of its blocks, which prefix doubling derives from the
identifiers of the round before: blocks that are equal as a whole repeat at all their positions at once, a bucket with one block holds no
repeat, and only buckets with different blocks are refined again, position by position.

Identifiers are hashes, so buckets need no numbering across tasks, and sorting by them is a shuffle.  Texts are shuffled
only to meet what was found about them; no group is held by a task: frequent buckets pass in bounded pieces with one row carried
on for each different block or string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import windows
from tessera.llm.common import prepare, written

#: Bytes looked at at once, blocks packed before a task hands them on, rows sorted at once.
SLICE, PACK, SORT = 1 << 19, 1 << 19, 1 << 20
#: Bytes of text for each packed partition.
SPREAD = 1 << 24


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each starts and the last ends."""
    texts = texts.cast(pa.large_string()) if texts.null_count == 0 else texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), offsets


def _segments(offsets: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, start, end) of up to SLICE bytes in all; long texts in pieces that share length - 1 bytes."""
    out, size = [], 0
    for i, n in enumerate(np.diff(offsets)):
        for s in range(0, int(n) - length + 1, SLICE):
            e = min(int(n), s + SLICE + length - 1)
            if size + e - s > SLICE + length and out:
                yield out
                out, size = [], 0
            out.append((i, s, e))
            size += e - s
    if out:
        yield out


def blocks(data: np.ndarray, offsets: np.ndarray, q: int, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bucket, identifier, text, first position, positions) of the blocks of the texts."""
    for segments in _segments(offsets, length):
        part = np.concatenate([data[offsets[i] + s : offsets[i] + e] for i, s, e in segments])
        sizes = np.array([e - s for _, s, e in segments])
        ends = np.cumsum(sizes)
        grams, strings = windows.identifiers(part, q, length)
        at = windows.anchors(grams, length - q + 1)
        n = len(strings)
        inside = np.ones(n, bool)  # strings that do not cross into the next segment
        for end in ends[:-1]:
            inside[max(0, end - length + 1) : end] = False
        change = at[1:n] != at[: n - 1]
        first = np.flatnonzero(inside & np.concatenate(([True], change | ~inside[:-1])))
        last = np.flatnonzero(inside & np.concatenate((change | ~inside[1:], [True])))
        whole = windows.joined(windows.joined(strings[first], strings[last]), ((last - first) << 16 | (at[first] - first)).astype(np.uint64))
        own = np.searchsorted(ends, first, "right")
        text = np.array([i for i, _, _ in segments])[own]
        base = np.array([s for _, s, _ in segments])[own] - (ends - sizes)[own]
        yield grams[at[first]], whole, text, first + base, last - first + 1


def _packed(docs: DataFrame, q: int, length: int, parts: int) -> DataFrame:
    """(p, pack): rows of (bucket, identifier, key, place) of the blocks, place being position << 8 | positions - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(held)
            p = ((rows[:, 0] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(p, kind="stable")
            rows, p = rows[order], p[order]
            at = np.flatnonzero(np.diff(p, prepend=np.uint64(parts)))
            packs = [rows[a:b].tobytes() for a, b in zip(at, [*at[1:], len(p)])]
            return pa.RecordBatch.from_arrays([pa.array(p[at].astype(np.int32)), pa.array(packs, pa.binary())], names=["p", "pack"])

        held, count = [], 0
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for bucket, whole, text, start, n in blocks(*_bytes_of(b.column(1)), q, length):
                held.append(np.stack((bucket, whole, keys[text].view(np.uint64), (start << 8 | (n - 1)).astype(np.uint64)), axis=1))
                count += len(bucket)
                if count >= PACK:
                    yield flush(held)
                    held, count = [], 0
        if held:
            yield flush(held)

    return docs.select("k", "text").mapInArrow(run, "p int, pack binary")


def _refined(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows whose block repeats, one row for each block of buckets with several, one row for each block)."""
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    new_bucket = np.diff(rows[:, 0], prepend=~rows[:1, 0]) != 0
    new = new_bucket | (np.diff(rows[:, 1], prepend=~rows[:1, 1]) != 0)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(rows)))
    one = rows[first]
    starts = np.flatnonzero(new_bucket[first])
    kinds = np.diff(np.append(starts, len(first)))
    return rows[np.repeat(size > 1, size)], one[np.repeat(kinds > 1, kinds)], one


def _met(packed: DataFrame) -> DataFrame:
    """(bucket, k, place, open): blocks that repeat as a whole (open = false), and blocks of buckets to refine further.

    A row may come more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((0, 4), np.uint64)

        def met(packs: list[bytes], carried: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
            same, various, one = _refined(np.concatenate([carried, *(np.frombuffer(x, np.uint64).reshape(-1, 4) for x in packs)]))
            both = np.concatenate((same, various)).view(np.int64)
            is_open = np.arange(len(both)) >= len(same)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 2]), pa.array(both[:, 3]), pa.array(is_open)], names=["bucket", "k", "place", "open"]), one

        packs, count, carried, p = [], 0, none, None
        for b in batches:
            for r, pack in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (r != p or count >= SORT) and packs:
                    got, carried = met(packs, carried)
                    yield got
                    packs, count = [], 0
                if r != p:
                    carried, p = none, r
                packs.append(pack)
                count += len(pack) // 32
        if packs:
            yield met(packs, carried)[0]

    return packed.repartition("p").sortWithinPartitions("p").mapInArrow(run, "bucket long, k long, place long, open boolean")


def _contents(docs: DataFrame, opened: DataFrame, length: int) -> DataFrame:
    """(bucket, k, start, content): the bytes of open blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _bytes_of(b.column(1))
            lists = b.column(2)
            own = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            place = flat.field("place").to_numpy(zero_copy_only=False)
            start, n = place >> 8, (place & 255) + 1
            at = offsets[own] + start
            contents = [data[x : x + m + length - 1].tobytes() for x, m in zip(at.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([flat.field("bucket"), b.column(0).take(pa.array(own)), pa.array(start), pa.array(contents, pa.binary())], names=["bucket", "k", "start", "content"])

    lists = opened.groupBy("k").agg(F.collect_set(F.struct("bucket", "place")).alias("open"))
    return docs.join(lists, "k").select("k", "text", "open").mapInArrow(run, "bucket long, k long, start long, content binary")


def _strings(rows: list[tuple[int, int, int, bytes]], length: int) -> np.ndarray:
    """(string, key, position) of every position of the given blocks."""
    data = np.frombuffer(b"".join([r[3] for r in rows]), np.uint8)
    sizes = np.array([len(r[3]) for r in rows])
    ids = windows.identifiers(data, 32, length)[1]
    n = sizes - length + 1
    begin = np.cumsum(sizes) - sizes
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    where = np.repeat(begin, n) + within
    keys = np.repeat(np.array([r[1] for r in rows], np.int64), n)
    position = np.repeat(np.array([r[2] for r in rows], np.int64), n) + within
    # a string's identifier takes that of its bucket, by which the rows came together
    bucket = np.repeat(np.array([r[0] for r in rows], np.int64).view(np.uint64), n)
    return np.stack((windows.joined(ids[where], bucket), keys.view(np.uint64), position.astype(np.uint64)), axis=1)


def _repeated(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose string stands at several places, one row for each string)."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.diff(rows[:, 0], prepend=~rows[:1, 0]) != 0
    other = new | (np.diff(rows[:, 1], prepend=~rows[:1, 1]) != 0) | (np.diff(rows[:, 2], prepend=~rows[:1, 2]) != 0)
    first = np.flatnonzero(new)
    places = np.add.reduceat(other.astype(np.int64), first)
    size = np.diff(np.append(first, len(rows)))
    return rows[np.repeat(places > 1, size)], rows[first]


def _runs(rows: np.ndarray) -> pa.RecordBatch:
    """(k, place) of runs of neighbouring positions, at most 256 long."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1]))][:, 1:].view(np.int64)
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] > rows[:-1, 1] + 1) | (rows[1:, 1] >> 8 != rows[:-1, 1] >> 8)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(rows)) - 1
    place = rows[first, 1] << 8 | (rows[last, 1] - rows[first, 1]) if len(rows) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(rows[first, 0]), pa.array(place)], names=["k", "place"])


def _positions(contents: DataFrame, length: int) -> DataFrame:
    """(k, place): runs of positions in open blocks whose strings repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((0, 3), np.uint64)
        held, size, carried = [], 0, none
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size >= SORT and held:
                    got, one = _repeated(np.concatenate((carried, _strings(held, length))))
                    yield _runs(got)
                    carried = one if row[0] == held[-1][0] else none
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield _runs(_repeated(np.concatenate((carried, _strings(held, length))))[0])

    return contents.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "k long, place long")


def _covered(places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal covered runs."""
    start = np.sort(places)
    start, end = start >> 8, (start >> 8) + (start & 255) + length
    end = np.maximum.accumulate(end)
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(fresh)
    return start[first], end[np.append(first[1:], len(start)) - 1]


def remove(docs: DataFrame, length: int = 200, q: int = 32, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans and the remaining bytes (kept, or kept_sha256).

    Removed is each byte covered by a string of ``length`` bytes (at most 256 + q) that starts at another place too, in the same text or another, judged on the
    input.  Texts are UTF-8; null texts are empty; rows with one id and text repeat each other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    docs = docs.withColumn("k", F.xxhash64("doc_id", "text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = written(_met(_packed(docs, q, length, max(16, -(-size // SPREAD)))), "blocks")
    contents = _contents(docs, found.where("open").select("bucket", "k", "place"), length)
    more = _positions(contents, length)
    places = found.where("not open").select("k", "place").unionByName(more).groupBy("k").agg(F.collect_set("place").alias("places"))
    kind, name, arrow = ("string", "kept_sha256", pa.string()) if digest else ("binary", "kept", pa.binary())
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _bytes_of(b.column(1))
            out: list[list] = [[], [], [], []]
            for i, lists in enumerate(b.column(2)):
                whole = data[offsets[i] : offsets[i + 1]]
                starts = ends = np.zeros(0, np.int64)
                if lists.is_valid:
                    starts, ends = _covered(lists.values.to_numpy(zero_copy_only=False), length)
                kept = b"".join([whole[x:y].tobytes() for x, y in zip([0, *ends.tolist()], [*starts.tolist(), len(whole)])])
                for column, value in zip(out, (len(whole), len(whole) - len(kept), len(starts), hashlib.sha256(kept).hexdigest() if digest else kept)):
                    column.append(value)
            columns = [b.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], arrow)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", name])

    rows = docs.join(places, "k", "left").select("doc_id", "text", "places")
    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, {name} {kind}")
