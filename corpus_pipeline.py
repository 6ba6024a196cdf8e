"""A training corpus from documents: toxic documents go, one of each group of near copies stays,
contaminated documents go, secrets are masked, and the rest is encoded.

In every stage a null or empty text is clean, links with nothing, holds no secret and has no tokens; texts of
any length are read whole; rows that repeat are judged each, and the near-copies stage keeps one of them; an
empty table stays empty. All stages but the last return the columns of documents, null values kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearweave.llm import bpe_codec, decontaminate, jaccard_join, secret_scan, toxicity
from hearweave.llm.common import new_path
from hearweave.llm.queries import pattern, table, tokenizer


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those predicted toxic; labels are learned as op10 learns them."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group of five-word shingle similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, words=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those contaminated by benchmark items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with secrets masked; n_chars follows the text."""
    masked = secret_scan.redacted(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with token ids, their number, and digests of the ids and of the bytes decoded from them."""
    ranks = tokenizer("byte_bpe_50k.tiktoken")
    both = bpe_codec.round_trip(docs, ranks, pattern(), "text", "ids", "decoded")
    return both.withColumns(
        {"n_tokens": F.size("ids").cast("long"), "decoded_sha256": F.sha2("decoded", 256)}
    ).drop("decoded")


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", near_copies_stage),
    ("decontaminate", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("byte_bpe", encoding_stage),
]

#: Scores, shingle joins, recursive decoding and BPE are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
