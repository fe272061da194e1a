"""Corpus pipeline: each stage gets the documents its predecessor kept.

All stages but the last return the columns of documents. Each row stays or goes by its own
text's decision: language ID and decontamination decide on whole rows as they pass, and
de-duplication tells rows apart by doc_id and text, so neither a null doc_id nor another row
with the same one matters. No stage writes texts other than its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ixpanel.llm import decontaminate, language, pieces, pii, simhash
from ixpanel.llm.common import table

MIN_SHARE = 0.4       # a document with a smaller share of words in its main language is rejected


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a main language, go."""
    return language.accepted(docs, language.learn(docs), MIN_SHARE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that with the smallest doc_id, or without one if
    no other has one; of several texts with it the one with the smallest hash, of equal rows any."""
    text = F.coalesce("text", F.lit(""))
    # Sorts by doc_id, null ones last, and tells texts apart.
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("a"),
                   F.hash(text).alias("b"), F.length(text).alias("n"), F.col("text").isNull().alias("no_text"))
    found = simhash.near_duplicates(docs.select(key.alias("doc_id"), "text"))
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("key")).distinct()
    rows = docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    once = rows.groupBy("key").agg(F.first("row").alias("row"))
    return once.join(gone, "key", "left_anti").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, whether or not the item has a number."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in angle brackets; n_chars follows."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(F.lit(0).alias("__"), *(F.col(f"`{c}`") for c in others)).alias("rest")   # no name can clash
    found = pii.find(docs.select("doc_id", "text", rest)).withColumn("text", pii.redacted())
    found = found.select("doc_id", "text", *(F.col(f"rest.`{c}`").alias(c) for c in others))
    if "n_chars" in others:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(docs.columns)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document: best segmentation, its score, and the alternatives."""
    return pieces.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii_redaction", pii_redaction),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

ORACLE_SQL = None     # language, fingerprints and segmentations are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
