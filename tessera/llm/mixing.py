"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words.  A source whose target is r times its size takes floor(r) whole copies
of each document, which is certain, and the rest of the target as a Pareto sample: document i has the
inclusion probability p_i = min(1, c * size_i), with c such that the expected words are the rest; it draws a
uniform number u_i from a hash of its id; documents are ranked by odds(u_i) / odds(p_i) and taken in
that order until the rest is reached (the last one only if that comes nearer).  Rows that repeat an id draw a number each.

The draw is made on small rows (id, source, size, times), written once.  All steps are joins and windows over (source) and (source, rank
bin): no window ever holds the documents of a source.  Ranks are cut in two steps, bins first and then the documents of the one bin in
which the target falls.  A source's one row meets its documents under SALT keys, so that a source with a third of all rows is no one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, Scratch, written

#: Rank bins for each source; the documents of one bin are ranked together.
BINS = 65536
#: Keys under which a source's row meets its documents.
SALT = 32


def word_count(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_copies: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights go round the sources in code point order, null last.  The total, ``share`` of all sizes, is split by
    weight; no target is above ``max_copies`` times the source's size, and what is cut off is shared again by weight.
    The end of that loop in closed form: sources in order of size / weight are full up to a point, and all
    others get weight * level.  One row a source passes through one window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    filling = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.lit(share) * F.col("total") - F.col("full")) / F.col("weight_left")
    return (
        sizes.withColumn("weight", weight)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum(F.lit(max_copies) * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(after))
        .withColumn("open", F.col("weight") * level <= F.lit(max_copies) * F.col("source_size"))
        .withColumn("level", F.max(F.when(F.col("open"), level)).over(everything))  # that of the first open source
        .select(
            "source",
            "source_size",
            F.least((F.lit(float(max_copies)) * F.col("source_size")), F.coalesce(F.col("weight") * F.col("level"), F.lit(float(max_copies)) * F.col("source_size"))).cast("double").alias("target"),
        )
    )


def _scales(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, rest, open_size, scale): the rest to sample, from which size on a document is certain, and c.

    groups: (mix_source, mix_size, times).
    """
    by_size = groups.where("mix_size > 0").groupBy(F.col("mix_source").alias("source"), F.col("mix_size").alias("size")).agg(F.sum("times").alias("n"))
    largest_first = Window.partitionBy("source").orderBy(F.col("size").desc())
    before = largest_first.rowsBetween(Window.unboundedPreceding, -1)
    after = largest_first.rowsBetween(0, Window.unboundedFollowing)
    plan = targets.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    plan = plan.withColumn("whole", F.floor("ratio").cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).drop("ratio")
    words, squares = F.col("n") * F.col("size"), F.col("n") * F.col("size") * F.col("size")
    cut = (
        by_size.withColumn("taken_before", F.coalesce(F.sum(words).over(before), F.lit(0)))
        .withColumn("squares_left", F.sum(squares.cast("double")).over(after))
        .join(plan.alias("t"), by_size["source"].eqNullSafe(F.col("t.source")))
        .select(F.col("t.source").alias("source"), "size", ((F.col("rest") - F.col("taken_before")) / F.col("squares_left")).alias("c"))
        .where(F.col("c") * F.col("size") < 1)
        .groupBy("source")
        .agg(F.max(F.struct("size", "c")).alias("m"))
        .select(F.col("source").alias("cut_source"), F.col("m.size").alias("open_size"), F.col("m.c").alias("scale"))
    )
    return plan.join(cut, plan["source"].eqNullSafe(cut["cut_source"]), "left").drop("cut_source")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 48 bits of a hash: the same in every run and on every engine."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 48))


def _met(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """``rows`` (mix_id, mix_source, ...) with the columns of ``by_source`` (source, ...), one row a source, under SALT keys."""
    salted = by_source.withColumnRenamed("source", "of_source").withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salt = F.pmod(F.xxhash64("mix_id", "mix_size"), F.lit(SALT)).cast("int")
    return rows.withColumn("mix_salt", salt).join(salted, F.col("mix_source").eqNullSafe(F.col("of_source")) & (F.col("mix_salt") == F.col("of_salt"))).drop("of_source", "of_salt", "mix_salt")


def _ranked(rows: DataFrame, seed: str) -> DataFrame:
    """``rows`` (mix_id, mix_size, mix_place, scale, open_size, ...) with their rank in [0, 1] and bin; certain ones have a bin of their own, -1."""
    size, u = F.col("mix_size"), F.col("mix_u")
    p = F.when(F.col("scale").isNull() | (size > F.col("open_size")), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("scale") * size)))
    # odds(u) / odds(p) as x / (1 + x), which has the same order
    below, above = u * (1 - F.col("mix_p")), (1 - u) * F.col("mix_p")
    key = F.coalesce(F.col("mix_id").cast("string"), F.lit("null"))
    return (
        rows.withColumn("mix_u", uniform(F.when(F.col("mix_place") == 0, key).otherwise(F.concat(key, F.lit("#"), F.col("mix_place").cast("string"))), seed))
        .withColumn("mix_p", p)
        .withColumn("mix_rank", F.when(size == 0, 1.0).otherwise(below / (below + above)))
        .withColumn("mix_bin", F.when(F.col("mix_p") >= 1, -1).otherwise(F.least(F.floor(F.col("mix_rank") * BINS), F.lit(BINS - 1))).cast("int"))
        .drop("mix_u", "mix_p")
    )


def _cuts(ranked: DataFrame, scales: DataFrame) -> DataFrame:
    """``scales`` with the bin in which each source's rest is reached, and the last rank and tie taken in it."""
    bins = ranked.groupBy("mix_source", "mix_bin").agg(F.sum("mix_size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("mix_source").orderBy("mix_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = (
        bins.withColumn("upto", upto)
        .where(F.col("upto") >= F.col("rest"))
        .groupBy("mix_source")
        .agg(F.min(F.struct("mix_bin", (F.col("upto") - F.col("words")).alias("so_far"))).alias("m"))
        .select(F.col("mix_source").alias("source"), F.col("m.mix_bin").alias("cut_bin"), F.col("m.so_far").alias("so_far"))
    )
    edge = _met(ranked, cut).where("mix_bin = cut_bin")
    in_order = Window.partitionBy("mix_source").orderBy("mix_rank", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("tie", _tie()).withColumn("upto_it", F.col("so_far") + F.sum("mix_size").over(in_order))
    nearer = (F.col("upto_it") - F.col("mix_size") < F.col("rest")) & (F.abs(F.col("upto_it") - F.col("rest")) < F.abs(F.col("upto_it") - F.col("mix_size") - F.col("rest")))
    last = edge.where((F.col("upto_it") <= F.col("rest")) | nearer).groupBy("mix_source").agg(F.max(F.struct("mix_rank", "tie")).alias("m"))
    last = last.select(F.col("mix_source").alias("last_source"), F.col("m.mix_rank").alias("last_rank"), F.col("m.tie").alias("last_tie"))
    cut = cut.withColumnRenamed("source", "cut_source").drop("so_far")
    out = scales.join(cut, scales["source"].eqNullSafe(cut["cut_source"]), "left")
    return out.join(last, out["source"].eqNullSafe(last["last_source"]), "left").drop("cut_source", "last_source")


def _tie() -> Column:
    """What orders documents of one rank."""
    return F.concat_ws("#", F.coalesce(F.col("mix_id").cast("string"), F.lit("")), F.lpad(F.col("mix_place").cast("string"), 19, "0"), F.col("mix_size").cast("string"))


def _sampled() -> Column:
    """Whether a ranked document is among those taken once more."""
    at, rank = F.col("mix_bin") == F.col("cut_bin"), F.col("mix_rank")
    taken = F.col("cut_bin").isNull() | (F.col("mix_bin") < F.col("cut_bin")) | (at & ((rank < F.col("last_rank")) | ((rank == F.col("last_rank")) & (_tie() <= F.col("last_tie")))))
    return (F.col("rest") > 0) & F.coalesce(taken, F.lit(False))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_copies: int = 2,
    seed: str = "mix:",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """All rows and columns of ``docs`` with mix_size, source_size, target, copies (0 to ``max_copies``) and taken.

    taken = copies * size.  Null and empty texts have size 0 and 0 copies.  A null source is a source of its own.  Rows
    that repeat id, source and size draw a number each, so that as many of them are taken as the sample has; which of them is left open.  An empty
    table gives no rows.  Columns that the result adds replace columns of ``docs`` with the same name.  Texts are not shuffled, those of
    such repeated rows aside: what decides a copy is one small row a source, joined to the documents where they are.
    """
    scratch = Scratch(docs.sparkSession)
    added = ["mix_size", "source_size", "target", "copies", "taken"]
    inner = ["mix_id", "mix_source", "mix_place", "mix_rank", "mix_bin", "mix_u", "mix_p", "mix_salt", "of_source", "of_salt", "whole", "rest", "open_size", "scale", "cut_bin", "last_rank", "last_tie"]
    sized = docs.drop(*[c for c in added + inner if c in docs.columns])
    kept = [F.col(f"`{c}`") for c in sized.columns]
    sized = sized.select(*kept, F.col(f"`{id_col}`").alias("mix_id"), F.col(f"`{source_col}`").alias("mix_source"), word_count(F.col(f"`{text_col}`")).alias("mix_size"))
    key = ["mix_id", "mix_source", "mix_size"]
    groups = scratch.write(sized.select(*key).groupBy(*key).agg(F.count(F.lit(1)).alias("times")), "groups")
    per_source = groups.groupBy(F.col("mix_source").alias("source")).agg(F.sum(F.col("mix_size") * F.col("times")).alias("source_size"))
    scales = scratch.write(_scales(groups, source_targets(per_source, weights, share, max_copies)), "scales")
    units = groups.where("mix_size > 0").withColumn("mix_place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))).drop("times")
    ranked = scratch.write(_ranked(_met(units, scales.select("source", "rest", "open_size", "scale")), seed), "ranked")
    cuts = written(_cuts(ranked, scales), "cuts")
    repeated = groups.where("times > 1 and mix_size > 0").select(*key)
    extra = F.when(_sampled() & (F.col("whole") < max_copies), 1).otherwise(0)
    plain = sized
    parts = []
    if not repeated.isEmpty():
        repeated = scratch.write(repeated, "repeats")
        same = lambda a, b: a["mix_id"].eqNullSafe(b["mix_id"]) & a["mix_source"].eqNullSafe(b["mix_source"]) & (a["mix_size"] == b["mix_size"])
        plain = sized.join(repeated, same(sized, repeated), "left_anti")
        again = sized.withColumn("mix_part", F.spark_partition_id()).join(repeated, same(sized, repeated), "left_semi")
        again = Scratch(docs.sparkSession).write(again, "again")
        parts.append(_numbered(again, key))
    parts.append(plain.withColumn("mix_place", F.lit(0).cast("long")))
    out = []
    for part in parts:
        rows = _ranked(_met(part, cuts), seed)
        copies = F.when(F.col("mix_size") == 0, F.lit(0)).otherwise(F.col("whole") + extra).cast("long")
        out.append(rows.withColumn("copies", copies).select(*kept, "mix_size", "source_size", "target", "copies", (F.col("copies") * F.col("mix_size")).alias("taken")))
    scratch.free("groups", "scales", "ranked")
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` (..., mix_part) with mix_place from 0 on among those of one key; numbered in each part, after the counts of the parts before."""
    counts = rows.groupBy(*key, "mix_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(k).alias(f"{k}_of") for k in key], F.col("mix_part").alias("part_of"), before.alias("start"))
    within = F.row_number().over(Window.partitionBy(*key, "mix_part").orderBy(F.lit(1))) - 1
    same = F.col("mix_part") == F.col("part_of")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_of"))
    numbered = rows.withColumn("mix_place", within.cast("long")).join(starts, same)
    return numbered.withColumn("mix_place", F.col("mix_place") + F.col("start")).drop("mix_part", "part_of", "start", *[f"{k}_of" for k in key])


def take(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every document as often as it was taken, with the given columns."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[F.col(f"`{c}`") for c in columns])


def long(name: str, alias: str) -> Column:
    """A column as long under another name."""
    return F.col(name).cast("long").alias(alias)
