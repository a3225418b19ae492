"""Which aliases of a dictionary stand in texts, or at their beginning.

A dictionary of bounded size becomes one automaton that every task builds once and runs over each text in a single pass.  A larger one is not
shipped: texts and aliases then meet by equality of short pieces, so that neither side need be small.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.latest import top_per

#: Characters of different aliases up to which the dictionary is shipped to tasks.
SHIPPED = 1 << 20

_built: dict[int, object] = {}


def _automaton(key: int, aliases: Sequence[str]) -> object:
    """The automaton of this worker for a shipped dictionary; an earlier one is dropped."""
    if key not in _built:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for a in aliases:
            machine.add_word(a, a)
        machine.make_automaton()
        _built.clear()
        _built[key] = machine
    return _built[key]


def found_in(c: Column, shipped, key: int) -> Column:
    """array<string>: the different aliases of a broadcast list in a text, the longest first, ties in order."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = _automaton(key, shipped.value)
        for texts in parts:
            found = [sorted({a for _, a in machine.iter(t)}, key=lambda a: (-len(a), a)) if isinstance(t, str) and t and len(machine) else [] for t in texts]
            yield pd.Series(found, dtype=object)

    # not to be pushed below the distinct texts that it is asked for, as a filter on what it finds else is
    return run.asNondeterministic()(c)


def _by_automaton(texts: DataFrame, aliases: DataFrame, text_col: str, alias_col: str, by: list[str]) -> DataFrame:
    spark = texts.sparkSession
    known = sorted(r[0] for r in aliases.select(alias_col).where(F.length(alias_col) > 0).distinct().collect())  # at most SHIPPED characters
    shipped = spark.sparkContext.broadcast(known)
    hits = texts.withColumn("__found", found_in(F.col(text_col), shipped, hash(tuple(known))))
    return hits.withColumn(alias_col, F.explode("__found")).drop("__found").join(aliases, [*by, alias_col])


def _by_pieces(texts: DataFrame, aliases: DataFrame, text_col: str, alias_col: str, by: list[str]) -> DataFrame:
    """An alias goes by the rarest of its pieces of three characters (all of it, if shorter), a text by all its different pieces.

    Only hashes of texts are copied for their pieces; the texts come back by these, and decide.
    """
    pieces = lambda c, q: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (q - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(q)))
    c, a = F.col(text_col), F.col(alias_col)
    keys = aliases.where(F.length(a) > 0).select(*by, alias_col).distinct().withColumn("__piece", F.explode(F.array_distinct(pieces(a, 3))))
    often = keys.groupBy(*by, "__piece").agg(F.count(F.lit(1)).alias("__n"))
    rarest = keys.join(often, [*by, "__piece"]).groupBy(*by, alias_col).agg(F.min(F.struct("__n", "__piece")).alias("__x")).select(*by, alias_col, F.col("__x.__piece").alias("__piece"))
    hashed = texts.where(c.isNotNull()).withColumn("__text", F.xxhash64(c))
    every = hashed.select(*by, "__text", F.explode(F.array_distinct(F.concat(pieces(c, 1), pieces(c, 2), pieces(c, 3)))).alias("__piece")).distinct()
    met = every.join(rarest, [*by, "__piece"]).select(*by, "__text", alias_col).distinct()
    return hashed.join(met, [*by, "__text"]).where(F.contains(c, a)).drop("__text").join(aliases, [*by, alias_col])


def containing(texts: DataFrame, aliases: DataFrame, text_col: str, alias_col: str, by: Sequence[str] = (), shipped: int = SHIPPED) -> DataFrame:
    """Rows of ``texts`` with the rows of ``aliases`` that they contain, equal in the columns ``by``.  An empty alias is in no text, a null text holds none.

    Dictionaries of up to ``shipped`` characters run as an automaton in tasks, larger ones are met by pieces.
    """
    size = aliases.select(alias_col).distinct().agg(F.sum(F.length(alias_col))).first()[0] or 0
    return (_by_automaton if size <= shipped else _by_pieces)(texts, aliases, text_col, alias_col, list(by))


def first_contained(texts: DataFrame, aliases: DataFrame, text_id: str, text: str, key: str, alias: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` aliases (longest first, then ``order``) that a text contains, among those with its key, with their rank."""
    hits = containing(texts, aliases, text, alias, by=[key])
    return top_per(hits, [text_id], [F.length(alias).desc(), *order], n=n, rank="rank")


def longest_prefixes(values: DataFrame, aliases: DataFrame, value: str, alias: str, least: int = 3) -> DataFrame:
    """Rows of ``values`` with the longest alias that they begin with, as `alias`, the rest as `suffix`, and `confidence` (1 whole, 0.9 with a rest).

    An alias of fewer than ``least`` characters may only stand before nothing or a rest with Chinese characters; a value whose longest alias
    may not stand has none.  Each different value meets aliases by its beginnings of the lengths that aliases have.
    """
    known = aliases.select(F.col(alias).alias("__alias")).where("__alias <> ''").distinct()
    lengths = known.agg(F.array_sort(F.collect_set(F.length("__alias"))).alias("__lengths"))  # one row: as many as lengths differ
    begun = values.select(F.col(value).alias("__value")).where("__value is not null").distinct().crossJoin(F.broadcast(lengths))
    begun = begun.withColumn("__n", F.explode("__lengths")).where(F.col("__n") <= F.length("__value")).select("__value", "__n", F.expr("substring(__value, 1, __n)").alias("__alias"))
    longest = begun.join(known, "__alias").groupBy("__value").agg(F.max(F.struct("__n", "__alias")).alias("x"))
    rest = F.expr("substring(__value, x.__n + 1)")
    safe = longest.withColumn("suffix", rest).where((F.col("suffix") == "") | (F.col("x.__n") >= least) | F.col("suffix").rlike("[\\x{4E00}-\\x{9FFF}]"))
    told = safe.select("__value", F.col("x.__alias").alias("alias"), F.nullif("suffix", F.lit("")).alias("suffix"))
    out = values.join(told, F.col(value) == F.col("__value"), "left").drop("__value")
    return out.withColumn("confidence", F.when(F.col("alias").isNotNull(), F.when(F.col("suffix").isNull(), F.lit(1.0)).otherwise(F.lit(0.9))))
