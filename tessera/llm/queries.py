"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, chat, divergence, html, jaccard, mixing, pii, quality, repeats, topk, warc, whitening
from tessera.llm.common import table


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents mixed by Pareto order sampling: sources weigh 3, 1, 2, repeating, and share 150% of all words."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", mixing.long("mix_size", "size"), "source_size", "target", "taken")


def op2_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html.main_text(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents encoded and decoded with a public vocabulary."""
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one with control strings in its texts, rendered and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.sample_with_controls(spark))
    return chat.digests(chat.format_log(chat.event_log(turns)))


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth of the embeddings."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_bucket_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without the bytes of 200-byte strings that stand at several places."""
    return repeats.remove(table(spark, sf_dir, "documents"), length=200, digest=True)


def op7_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a similarity of at least 0.9."""
    return jaccard.join(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents: the base patterns' spans and those that boosted trees add."""
    return pii.detect(table(spark, sf_dir, "documents"))


def op9_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest integer inner products of every hundredth of the embeddings."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents scored by a ranking learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"), at=0.3))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def op11_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as an archive, deduplicated by payload and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart the sources of each language are in all documents, and the terms that set each apart."""
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=30, ranks=50)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their 8 leading components at unit variance; a deviation that no long can hold is null."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), k=8)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {f.__name__: f for f in (op1_pareto_mixing, op2_wrapper_induction, op3_bpe, op4_chat_format, op5_cross_polytope, op6_bucket_pointer, op7_partenum_join, op8_pii, op9_pivot_topk, op10_bradley_terry, op11_warc_revisits, op12_source_divergence, op13_whitening)}
