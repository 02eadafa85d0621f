"""Training corpus in five stages: quality rules, near-duplicates, secrets, mixing, encoding.

Each stage takes the documents that its predecessor kept and returns documents again, the last one token ids; between stages the
documents are written and read back.

In every stage a null text counts as empty, very long texts are worked on whole, repeated rows and equal ids are rows like others
unless a stage says more, an empty table gives an empty table, and further columns come along (but for the last stage) under any
name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlay_jobs.llm import bpe, minhash, mixing, quality, secrets
from overlay_jobs.session import settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the cascade rejects go: null and empty texts among them, as they have no words; repeated rows get one verdict."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays, once; a null id only where a class has no other."""
    return minhash.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kinds; n_chars follows where it is a column. Null texts stay null."""
    out = docs.withColumn("text", secrets.redacted(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or several times. Documents without words have no size, and may go."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit integers, little-endian), and digests of the ids and of the text they
    decode to; a row per row, null texts without tokens."""
    return bpe.round_trip(docs, with_ids=True)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scans", secret_scans), ("source_mix", source_mix), ("encode", encode)]

#: Near-duplicates, automata and encoding are beyond SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = settle(docs, f"pipeline-{name}")
    return docs
