"""Exact top-k inner product search with a pivot table.

Pivots are rows far from one another, chosen from a bounded sample; the distances of every vector to all pivots are computed once and
travel with it: the pivot table.  For a query q and a vector x, |d(q, p) - d(x, p)| is at most d(q, x) for every pivot p, and
q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2; so the largest of those differences bounds q.x from above.  Candidates are evaluated in the
order of their bounds until the next bound cannot beat the k-th score found: all others are eliminated without being evaluated.
How many that are depends on the vectors: many where these form clusters, none where all are about equally far apart.

Queries meet the candidates in blocks: rows are dealt into candidate blocks and query blocks of bounded size by a hash of
their id, so that neither a frequent vector nor a large query set gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import prepare, written

#: Rows of a candidate block and of a query block.
CANDIDATE_BLOCK, QUERY_BLOCK = 16384, 8192
#: Pivots, rows of the sample that they are chosen from, and candidates evaluated between the first two looks at the bounds.
PIVOTS, SAMPLE, STEP = 32, 2048, 64
#: Slack for rounding in distances, relative to the squared norms.
SLACK = 1e-9
#: Up to this product of largest components and dimensions, sums of integers are exact in double precision.
EXACT = 2**52


def finite(vector: Column) -> Column:
    """Whether a vector takes part: not null, with components, none null or non-finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False))


def quantized(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` different rows of x, each the one farthest from those before; the first is the one farthest from the mean."""
    if not len(x):
        return x
    chosen = [int(np.argmax(distances(x, x.mean(0, keepdims=True))[:, 0]))]
    near = distances(x, x[chosen])[:, 0]
    while len(chosen) < min(n, len(x)) and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of the rows of x to the rows of p."""
    d = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2.0 * (x @ p.T)
    return np.sqrt(np.maximum(d, 0.0))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    return np.lexsort((ids, -score))[:k]


def search_block(q: np.ndarray, q_ids: np.ndarray, q_table: np.ndarray, x: np.ndarray, x_ids: np.ndarray, table: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query id, ids, scores, candidates evaluated) for each query against one block.

    q and x hold integers as doubles or objects; q_table and table their rows of the pivot table.
    """
    qf, xf = q.astype(float), x.astype(float)
    x_sq, q_sq = (xf * xf).sum(1), (qf * qf).sum(1)
    most = x_sq.max(initial=0.0)
    out = []
    for i in range(len(q_ids)):
        gap = np.zeros(len(x))
        for j in range(table.shape[1]):
            np.maximum(gap, np.abs(table[:, j] - q_table[i, j]), out=gap)
        bound = (q_sq[i] + x_sq - gap * gap) / 2 + SLACK * (q_sq[i] + most) + 1e-6
        own = np.flatnonzero(x_ids == q_ids[i])
        bound[own[(x[own] == q[i]).all(1)][:1]] = -np.inf
        ids, scores, seen, step = np.empty(0, np.int64), np.empty(0, x.dtype), 0, STEP
        left = np.flatnonzero(bound > -np.inf)
        while len(left):
            take, rest = left, left[:0]
            if step < len(left):
                parted = np.argpartition(-bound[left], step - 1)
                take, rest = left[parted[:step]], left[parted[step:]]
            seen += len(take)
            ids, scores = np.concatenate((ids, x_ids[take])), np.concatenate((scores, x[take] @ q[i]))
            keep = _best(scores, ids, k)
            ids, scores = ids[keep], scores[keep]
            left = rest[bound[rest] >= scores[-1]] if len(ids) >= k else rest
            step *= 4
        out.append((int(q_ids[i]), ids, scores, seen))
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of integers as rows of doubles, or of Python integers where doubles would not be exact."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """Pivots for each length of vectors (id, v, dim), from the SAMPLE rows with the least hashes."""
    got = rows.select("v", "dim").orderBy(F.xxhash64("v", F.lit(7))).limit(SAMPLE).toArrow()
    dims = got["dim"].to_numpy()
    return {int(d): farthest_first(_matrix(got.filter(pa.array(dims == d))["v"]).astype(float), PIVOTS) for d in np.unique(dims)}


def with_table(rows: DataFrame, chosen: dict[int, np.ndarray]) -> DataFrame:
    """Rows (id, v, dim, asks) with their distances to the pivots; vectors of a length that the sample lacks have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, lists = b.column(2).to_numpy(), [None] * len(b)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = _matrix(pa.chunked_array([b.column(1).take(pa.array(at))])).astype(float)
                for i, t in zip(at.tolist(), distances(x, chosen.get(d, np.zeros((0, d)))).tolist()):
                    lists[i] = t
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.float64()))], names=[*b.schema.names, "t"])

    return rows.mapInArrow(run, "id long, v array<long>, dim int, asks boolean, t array<double>")


def found_by_block(vectors: DataFrame, is_query: Column, k: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(query_id, ids, scores, seen, held): for each query and block the k best, and how many of the block's rows were evaluated."""
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col(f"`{vector_col}`")
    rows = vectors.where(finite(v) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), quantized(v, scale).alias("v"), F.size(v).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks, q_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    rows = written(with_table(rows, pivots(rows)), "pivot-table")
    deal = lambda seed, m: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    cands = rows.select("id", "v", "t", "dim", deal(1, blocks).alias("c"), every(q_blocks).alias("b"))
    once = rows.where("asks").groupBy("id").agg(F.min(F.struct("v", "dim", "t")).alias("x"))
    asks = once.select(F.col("id").alias("id"), "x.v", "x.t", "x.dim", deal(2, q_blocks).alias("b"), every(blocks).alias("c"))

    def block(x: pa.Table, q: pa.Table) -> pa.Table:
        found = []
        if x.num_rows and q.num_rows:
            xm, qm = _matrix(x["v"]), _matrix(q["v"])
            largest = [max(abs(int(m.max())), abs(int(m.min()))) for m in (xm, qm)]
            kind = float if largest[0] * largest[1] * xm.shape[1] < EXACT else object
            found = search_block(qm.astype(kind), q["id"].to_numpy(), _matrix(q["t"]), xm.astype(kind), x["id"].to_numpy(), _matrix(x["t"]), k)
        columns = [[f[0] for f in found], [f[1].tolist() for f in found], [[int(s) for s in f[2]] for f in found], [f[3] for f in found], [x.num_rows] * len(found)]
        lists = pa.list_(pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), lists, lists, pa.int64(), pa.int64()))], names=["query_id", "ids", "scores", "seen", "held"])

    keys = ["c", "b", "dim"]
    return cands.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(block, "query_id long, ids array<long>, scores array<long>, seen long, held long")


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest integer inner product for each query row.

    Components become floor(scale * x).  Rows whose vector is null, empty or holds a null or non-finite component take no part, nor
    do rows without id.  A query's own row is no candidate; all other rows are, also those with its id (they meet it in
    one block, where the first that equals it is its own). Of several query rows with one id the one with the smallest vector asks.  Vectors of
    another length than the query's are no candidates.  Ties go to the smaller id; with fewer than k candidates all are returned.  Empty
    tables give no rows.  Sums that no long can hold raise an error.
    """
    return ranked(found_by_block(vectors, is_query, k, scale, id_col, vector_col), k, "long")


def evaluated(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(evaluated, held): over all queries, how many candidates were evaluated, and how many there were; the rest the bounds eliminated."""
    return found_by_block(vectors, is_query, k, scale, id_col, vector_col).agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("evaluated"), F.coalesce(F.sum("held"), F.lit(0)).alias("held"))


def ranked(per_block: DataFrame, k: int, kind: str) -> DataFrame:
    """(query_id, rank, vec_id, score) from arrays of ids and scores by query and block."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (
        per_block.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x"))
        .select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").cast(kind).alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
