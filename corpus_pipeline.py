"""A corpus pipeline over documents: clean, drop copies, mix to target weights, encode.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; the driver writes it as
Parquet and reads it again as the next stage's docs. All stages but the last return the columns of
documents. Each works on every row that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import lines, mixing, sentencepiece, simhash
from graphloom.llm.queries import model_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their lines above the limits."""
    return lines.apply_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their sites' boilerplate lines."""
    return lines.line_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a last part of one may be taken alone."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, end id included, and the hash of what they decode to."""
    encoded = sentencepiece.encode(docs, model_path(), decoded="decoded_sha256")
    return encoded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded_sha256")


STAGES = [("quality_rules", quality), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("mixing", mix), ("sentencepiece", encode)]

#: SQL has no SimHash or SentencePiece; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
