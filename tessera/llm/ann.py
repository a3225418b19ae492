"""Approximate nearest neighbours by cross-polytope hashing.

A table turns vectors by fast Hadamard pseudo-rotations (random signs, then a Hadamard transform, three times) and assigns each to
the nearest signed axis: the largest component by absolute value, with its sign.  Queries probe the buckets whose axes lie
nearest in every table; only the candidates that a table collects are multiplied with the query, and ranked by their exact inner products.
How many these are depends on the vectors: few where they form clusters, about half of all where they are about equally far apart, as then no
bucket holds much more of the near ones than of others.  That share is the same for any number of rows, so recall does not fall as tables grow.

Every row is hashed once.  Rows are dealt into blocks of bounded size, each of which sorts its rows by their keys in every table, and queries go with
their probes to every block: a candidate is shuffled once and multiplied once, however many tables it shares with a query, and a frequent vector or
bucket does not gather in one task.  A query set that grows with the table meets a number of blocks that does, so work grows with the square, as in an exact search,
and the tables lower it by the share that they leave out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare
from tessera.llm.topk import finite, ranked

#: Rows of a candidate block and of a query block.
CHUNK, QUERY_CHUNK = 8192, 4096
#: Many tables with few probes find more than few with many, for as many products.
TABLES, PROBES = 20, 6


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row; the length is a power of two."""
    x, h, (n, d) = x.copy(), 1, x.shape
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, table: int, turn: int) -> np.ndarray:
    """One pseudo-rotation of the rows, padded with zeros to a power of two."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    signs = np.random.default_rng([11, table, turn]).choice(np.array([-1.0, 1.0]), (3, d))
    for s in signs:
        x = hadamard(x * s)
    return x


def buckets(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The ``probes`` best keys of each row, best first: the signed axes with the largest components."""
    r = rotated(x, table, 0)
    both = np.concatenate((r, -r), axis=1)
    m = min(probes, both.shape[1])
    near = np.sort(np.argpartition(-both, m - 1, axis=1)[:, :m], axis=1)
    order = np.argsort(-np.take_along_axis(both, near, 1), axis=1, kind="stable")
    return np.take_along_axis(near, order, 1)


def _units(column: pa.Array, longest: float | None) -> np.ndarray:
    """Unit vectors; where lengths differ, one more component makes all as long as the longest, queries staying flat."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    if longest is not None:
        v = np.concatenate((v, np.sqrt(np.maximum(longest**2 - (v * v).sum(1, keepdims=True), 0.0))), axis=1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _hashed(rows: DataFrame, tables: int, probes: int, longest: float | None, flat: bool) -> DataFrame:
    """``rows`` (id, v, dim) with keys: the ``probes`` best in each table, one table after the other, as 32-bit numbers."""
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in sorted(set(batch.column(2).to_pylist())):
                part = batch.filter(pc.equal(batch.column(2), dim))
                if flat and longest is not None:
                    u = _units(part.column(1), None)
                    u = np.concatenate((u, np.zeros((len(u), 1))), axis=1)
                else:
                    u = _units(part.column(1), longest)
                keys = np.concatenate([buckets(u, t, probes) for t in range(tables)], axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([k.tobytes() for k in keys], pa.binary())], names=["id", "v", "dim", "keys"])

    return rows.mapInArrow(run, f"id long, v {kind}, dim int, keys binary")


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with q, added up from the first component to the last."""
    return np.cumsum(x * q, axis=1)[:, -1]


class Tables:
    """The buckets of a block: in each table the rows of every key, as places in an order of the rows."""

    def __init__(self, keys: np.ndarray):
        self.orders = [np.argsort(k, kind="stable") for k in keys.T]
        self.ends = [np.searchsorted(k[o], np.arange(int(k.max(initial=-1)) + 2)) for k, o in zip(keys.T, self.orders)]
        self.seen = np.zeros(len(keys), bool)

    def collected(self, probed: np.ndarray) -> np.ndarray:
        """The rows in any bucket that a query probes (several keys a table), each once, in order."""
        several = len(probed) // max(1, len(self.orders))
        for t, (order, ends) in enumerate(zip(self.orders, self.ends)):
            for key in probed[t * several : (t + 1) * several]:
                if key + 1 < len(ends):
                    self.seen[order[ends[key] : ends[key + 1]]] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


def rerank(q: np.ndarray, q_ids: np.ndarray, probed: np.ndarray, x: np.ndarray, x_ids: np.ndarray, keys: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query id, ids, scores, products) of the k best of one block for each query, ties to smaller ids.

    Only rows that a table collects are multiplied; products says how many these were.
    """
    tables, out = Tables(keys), []
    for i, id_ in enumerate(q_ids.tolist()):
        near = tables.collected(probed[i])
        products = len(near)
        held = x[near]
        near = near[~((x_ids[near] == id_) & (held == q[i]).all(axis=1))] if (x_ids[near] == id_).any() else near
        scores = x[near] @ q[i] if len(near) < products else held @ q[i]
        if len(near) > k:
            kth = np.partition(scores, -k)[-k]
            near = near[scores >= kth - 1e-9 * max(1.0, abs(kth))]
        exact = exact_scores(x[near], q[i])
        keep = np.lexsort((x_ids[near], -exact))[:k]
        out.append((id_, x_ids[near][keep], exact[keep], products))
    return out


def found_by_block(vectors: DataFrame, is_query: Column, k: int, tables: int, probes: int, id_col: str, vector_col: str) -> DataFrame:
    """(query_id, ids, scores, products, held): for each query and block the k best, how many of its rows were multiplied, and how many it has."""
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col(f"`{vector_col}`")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.where(finite(v) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast(kind).alias("v"), F.size(v).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.withColumn("length", length).where("length > 0 and length < double('infinity')")
    n, n_queries, shortest, longest = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.min("length"), F.max("length")).first()
    uneven = longest if n and longest > 1.001 * shortest else None
    blocks, q_blocks = max(1, -(-n // CHUNK)), max(1, -(-n_queries // QUERY_CHUNK))
    deal = lambda m, *salt: F.pmod(F.xxhash64("id", *salt), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    once = rows.where("asks").groupBy("id").agg(F.min(F.struct("v", "dim")).alias("x")).select(F.col("id").alias("id"), "x.v", "x.dim")
    cands = _hashed(rows.select("id", "v", "dim"), tables, 1, uneven, False).select("*", deal(blocks, "v", F.spark_partition_id()).alias("c"), every(q_blocks).alias("b"))
    asks = _hashed(once, tables, probes, uneven, True).select("*", deal(q_blocks).alias("b"), every(blocks).alias("c"))

    def block(x: pa.Table, q: pa.Table) -> pa.Table:
        found = []
        if x.num_rows and q.num_rows:
            xm, qm = (m["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(m.num_rows, -1).astype(float) for m in (x, q))
            keys, probed = (np.frombuffer(b"".join(m["keys"].to_pylist()), np.int32).reshape(m.num_rows, -1) for m in (x, q))
            found = rerank(qm, q["id"].to_numpy(), probed, xm, x["id"].to_numpy(), keys, k)
        columns = [[f[0] for f in found], [f[1].tolist() for f in found], [f[2].tolist() for f in found], [f[3] for f in found], [x.num_rows] * len(found)]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["query_id", "ids", "scores", "products", "held"])

    keys = ["c", "b", "dim"]
    return cands.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(block, "query_id long, ids array<long>, scores array<double>, products long, held long")


def search(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found with the largest inner product, in double precision, for each query row.

    Rows whose vector is null, empty, zero or holds a null or non-finite component take no part, nor do rows without id.  A query's own row, and rows
    that repeat its id and vector, are no candidates; all other rows are, also where ids repeat; of several query rows with one id the one with the
    smallest vector asks.  Vectors of another length than the query's are no candidates.  Ties go to the smaller id.
    Empty tables give no rows.  Every row is indexed; recall depends on ``tables`` and ``probes``.
    Where lengths differ by more than a thousandth, hashing sees vectors extended to equal length, which keeps the order of inner products.
    """
    return ranked(found_by_block(vectors, is_query, k, tables, probes, id_col, vector_col), k, "double")


def evaluated(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = TABLES, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(products, held): over all queries, how many rows the tables collected to be multiplied, and how many there were."""
    return found_by_block(vectors, is_query, k, tables, probes, id_col, vector_col).agg(F.coalesce(F.sum("products"), F.lit(0)).alias("products"), F.coalesce(F.sum("held"), F.lit(0)).alias("held"))
