"""A corpus from documents in five stages: quality, near duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes each as Parquet in the shared folder and reads it again
for the next.  All but the last return the columns of documents; other columns of their input are left out, whatever their names.

Null and empty texts: quality scores them as empty texts (and rejects them where the ranking says so), near_duplicates keeps all that come to it,
as they are linked with nothing, the mixture takes none of them.  A null doc_id is an id like others, but the last choice of a group of copies; repeated
rows are one group of copies.  Empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, mixing, pii, quality
from tessera.llm.common import Scratch, pick, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking learned from labels does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), at=0.3)
    return pick(quality.score(pick(docs, *COLUMNS), model).where("quality_score >= 0.3"), *COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least doc_id, nulls last, of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    return pick(jaccard.survivors(pick(docs, *COLUMNS), words=5, num=80, den=100), *COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their kinds in place of personal data; n_chars follows."""
    return pick(pii.redact(pick(docs, *COLUMNS)).withColumn("n_chars", F.length("text").cast("long")), *COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return pick(mixing.take(mixing.mix(pick(docs, *COLUMNS)), list(COLUMNS)), *COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and hashes of the token ids and of what they decode to."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True)


STAGES = [
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixture", mix_sources),
    ("tokens", encode_tokens),
]

#: SQL cannot train, find spans by trees or encode: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; a stage's table goes when the next one is written."""
    scratch = Scratch(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            scratch.free(before)
        before = f"stage-{name}"
    return docs
