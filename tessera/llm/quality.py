"""Quality scores by Bradley-Terry pairwise ranking.

A labelled good document is preferred to a labelled bad one.  Of such preference pairs a linear score is learned by logistic
loss on the differences of the two documents' features.  The cut lies at the quantile of the scores that
the share of bad labels names, and scores are mapped to 0..1 with the cut at a given value.

Features come from the text alone.  The fit sees a bounded sample of labelled rows and pairs (both parameters); every
document is scored in its own task, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare

UPPER, LOWER = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[a-zß-öø-ÿ]")
DIGIT, MARK, ODD = re.compile(r"[0-9]"), re.compile(r"[.,;:!?]"), re.compile(r"[#$%&*|<>{}\\^~_=+@/]")
#: Sentence ends: a mark after a letter, then white space or the end.
END = re.compile(r"[^\W\d_][.!?](?=\s|$)")


def raw_features(text: str) -> list[float]:
    """Shares and lengths of one text; zeros for an empty one."""
    words = text.split()
    n, m = len(text), len(words)
    if not m:
        return [0.0] * 18
    counts = Counter(words)
    lines = text.split("\n")
    upper, lower = len(UPPER.findall(text)), len(LOWER.findall(text))
    same = sum(map(str.__eq__, words, words[1:])) / m
    pairs = len(set(zip(words, words[1:]))) / max(1, m - 1)
    line_counts = Counter(x for x in lines if x)
    most = counts.most_common(1)[0][1]
    long_words = sum([len(w) for w in counts if len(w) > 20])
    return [
        math.log1p(n) / 10,
        math.log1p(m) / 10,
        n / m / 10,
        len(counts) / m,
        min(1.0, len(counts) / math.sqrt(m) / 20),
        most / m,
        same,
        pairs,
        upper / max(1, upper + lower),
        len(DIGIT.findall(text)) / n,
        len(MARK.findall(text)) / m,
        len(ODD.findall(text)) / m,
        text.count("!") / m,
        text.count("|") / m,
        len(END.findall(text)) / m,
        len(lines) / m,
        1 - len(line_counts) / max(1, sum(line_counts.values())),
        long_words / n,
    ]


def features(texts: list[str]) -> np.ndarray:
    """Features with squares, square roots and whether they are large, so that a linear score can bend."""
    x = np.array([raw_features(t) for t in texts]).reshape(len(texts), -1)
    return np.concatenate((x, np.minimum(x, 4) ** 2, np.sqrt(x), (x > 0.3).astype(float), (x > 0.05).astype(float)), axis=1)


@dataclass
class Model:
    """Score of a text: weights on standardized features, then a logistic curve with the cut at ``at``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    at: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + math.log(self.at / (1 - self.at))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(d: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 12) -> np.ndarray:
    """Weights of a logistic regression without intercept, by Newton steps."""
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        g = d.T @ (p - y) + ridge * w
        h = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, at: float = 0.3, pairs: int = 20_000, ridge: float = 1.0) -> Model:
    """Learn from features and labels.  Without labels of both kinds there is no preference: all scores are 0.5."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    width = x.shape[1]
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0, 0.5)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(3)
    n = min(pairs, len(good) * len(bad))
    d = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    sign = np.where(np.arange(n) % 2 == 0, 1.0, -1.0)  # either order, so that both outcomes occur
    weights = _logistic(d * sign[:, None], (sign > 0).astype(float), ridge)
    raw = z @ weights
    cut = float(np.quantile(raw, len(bad) / len(y)))
    slope = float(max(0.05, _logistic(np.stack((raw - cut, np.ones(len(raw))), 1), y.astype(float), 1.0)[0]))
    return Model(mean, scale, weights, cut, min(slope, 5.0), at)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: a fifth, by a checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, at: float = 0.3, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from at most ``sample`` labelled rows, those with the smallest hashes, none of them held out.

    The sample's ids are broadcast (their number is bounded) and only its texts leave the scan; what comes to the
    driver is one row of numbers for each.  Null labels and null ids teach nothing; different labels of one id count each.  Of documents that
    share an id the one with the least hash teaches, which tasks find before any shuffle.
    """
    prepare(docs.sparkSession)
    key = F.col(f"`{id_col}`")
    learn = labels.where(F.col(f"`{label_col}`").isin(0, 1) & key.isNotNull() & ~held_out(key)).select(key.alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).distinct()
    learn = learn.withColumn("h", F.xxhash64("id")).orderBy("h", "id", "y").limit(sample).select("id", "y")
    texts = docs.select(key.alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(learn), "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("id", "x.text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "y", "x"])

    got = chosen.mapInArrow(run, "id long, y int, x array<double>").toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, features([""]).shape[1])), np.zeros(0))
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    order = np.lexsort((*x.T[:4], got["y"].to_numpy(), got["id"].to_numpy()))
    return fit(x[order], got["y"].to_numpy()[order], at)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with quality_score (0 to 1).

    Null texts count as empty.  Columns of ``docs`` named quality_score are replaced.  An empty table gives no rows.  Equal texts get equal scores.
    """
    prepare(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features([t or "" for t in texts.to_pylist()])), pa.float64())

    return docs.drop("quality_score").withColumn("quality_score", scored(F.col(f"`{text_col}`").cast("string")))
