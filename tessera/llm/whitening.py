"""Embedding whitening: principal components by a randomised range finder, and rows projected on them at unit variance.

A random start of `components` + OVERSAMPLING directions is multiplied by the covariance in repeated passes over all centred rows; each pass is a Spark job whose tasks add up
their rows' share of a matrix of (dimensions x directions), which Spark sums by line.  Since a pass gives the covariance's image of an orthonormal basis,
Rayleigh-Ritz on the basis and the residuals of its vectors come with it.  Where the residuals do not fall to TOLERANCE in PASSES, or fall too slowly to get there,
the basis grows to the full dimension, and one more pass ends the search: a flat spectrum costs a few passes more, never a wrong component.

Components x become floor(scale * x) + offset.  n * x - S is computed in integers, so centring loses nothing however far the mean lies from zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, prepare
from tessera.llm.topk import finite, quantized

OVERSAMPLING, PASSES, SEED = 8, 12, 13
#: Residuals, relative to the largest eigenvalue, at which components count as found; eigenvalues below RANK of it have no component.
TOLERANCE, RANK = 1e-13, 1e-12
#: Products of integers stay below this bound, or Python's integers take over.
EXACT = 2**62


@dataclass
class Model:
    """n rows with sums S; unit components as columns, with their eigenvalues; the trace of the covariance; how many passes it took."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    expanded: bool


def _lines(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def total(rows: DataFrame, share: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all rows (x) of share(matrix of some rows), a matrix of ``kind`` long or double; None without rows.

    A task hands on one matrix by lines; a line of the sum gathers one row from each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for b in batches:
            if len(b):
                part = share(_lines(b.column(0)))
                sums = part if sums is None else sums + part
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(list(sums), pa.list_(pa.int64() if kind == "long" else pa.float64()))], names=["line", "v"])

    def add(t: pa.Table) -> pa.Table:
        summed = _lines(t["v"].combine_chunks()).sum(0)
        return pa.table({"line": t["line"][:1], "v": pa.array([summed], t["v"].type)})

    schema = f"line int, v array<{kind}>"
    got = rows.mapInArrow(run, schema).groupBy("line").applyInArrow(add, schema).toArrow().sort_by("line")
    return _lines(got["v"].combine_chunks()) if got.num_rows else None


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly: longs, or Python's integers where those could overflow."""
    largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    kind = np.int64 if n * largest < EXACT else object
    return n * x.astype(kind) - sums.astype(kind)


def squares(y: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    largest = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
    return (y.astype(np.int64 if largest * largest * max(1, y.shape[1]) < EXACT else object) ** 2).sum(1).tolist()


def fit(rows: DataFrame, k: int, oversampling: int = OVERSAMPLING, passes: int = PASSES, tolerance: float = TOLERANCE) -> Model | None:
    """The leading ``k`` components of rows (x array<long>, all of one length); None without rows."""
    first = total(rows, lambda x: np.vstack((x.sum(0), np.full(x.shape[1], len(x)))), "long")
    if first is None:
        return None
    sums, n, dim = first[0], int(first[1][0]), first.shape[1]

    def image(basis: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance times the basis, and the covariance's trace, from one pass."""

        def share(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums).astype(float) / n
            return np.hstack((c.T @ (c @ basis), (c * c).sum(0)[:, None]))

        got = total(rows, share, "double") / n
        return got[:, :-1], float(got[:, -1].sum())

    rng = np.random.default_rng(SEED)
    width, before, turn = min(dim, k + oversampling), None, 0
    basis = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    while True:
        moved, trace = image(basis)
        turn += 1
        ritz = basis.T @ moved
        values, turned = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        found = basis @ turned
        if values[0] <= 0 or basis.shape[1] == dim:
            break
        residual = float(np.linalg.norm(moved @ turned - found * values, axis=0)[:k].max() / values[0])
        if residual <= tolerance:
            break
        hopeless = before is not None and (residual >= before or residual * (residual / before) ** (passes - turn) > tolerance)
        basis = np.eye(dim) if hopeless or turn >= passes else np.linalg.qr(moved)[0]
        before = residual
    keep = int((values[:k] > RANK * max(values[0], 0)).sum())
    chosen = found[:, :keep]
    chosen = chosen / np.linalg.norm(chosen, axis=0) * np.where(chosen[np.abs(chosen).argmax(0), np.arange(keep)] < 0, -1, 1)
    return Model(n, sums, chosen, values[:keep], trace, turn, width < dim and basis.shape[1] == dim)


def project(rows: DataFrame, model: Model) -> DataFrame:
    """(id, deviation decimal(38,0), whitened array<double>) of rows (x, id)."""
    n, sums, scaled = model.n, model.sums, model.components / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                y = centred(_lines(b.column(0)), n, sums)
                deviation = pa.array([Decimal(d) for d in squares(y)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([b.column(1), deviation, pa.array(list((y.astype(float) / n) @ scaled), pa.list_(pa.float64()))], names=["id", "deviation", "whitened"])

    return rows.mapInArrow(run, "id long, deviation decimal(38,0), whitened array<double>")


def whiten(vectors: DataFrame, k: int = 8, scale: int = 1024, offset: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error) for each row and component up to ``k``.

    Rows whose vector is null, empty or holds a null or non-finite entry take no part, nor do, where lengths differ, rows of another length than most have (ties: the
    longer), since a covariance needs one.  Entries must fit in a long after scaling.  All other rows are fitted and returned, also those
    that repeat or have no id.  Components whose eigenvalue is zero (constant or fewer rows than dimensions) have no whitened value and are left out: a single row gives none.
    Eigenvalues that tie may have any basis of their space.  A component's sign is that of its largest entry.  Empty tables give no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    v = F.col(f"`{vector_col}`")
    rows = vectors.where(finite(v)).select(F.transform(quantized(v, scale), lambda x: x + F.lit(offset)).alias("x"), F.col(f"`{id_col}`").cast("long").alias("id"))
    rows = scratch.write(rows, "integer-vectors")
    lengths = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.col("count").desc(), F.col("dim").desc()).first()
    rows = rows.where(F.size("x") == (lengths["dim"] if lengths else 0))
    model = fit(rows, k)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    done = scratch.write(project(rows, model), "whitened-vectors")
    scratch.free("integer-vectors")
    w = done.select("whitened")
    mean = total(w, lambda x: x.sum(0)[None], "double")[0] / model.n
    covariance = total(w, lambda x: (x - mean).T @ (x - mean), "double") / model.n
    error = float(np.abs(covariance - np.eye(len(model.values))).max())
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    out = done.select("id", "deviation", F.posexplode("whitened").alias("place", "w"))
    return out.select(F.col("id").alias("vec_id"), (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"), F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))
