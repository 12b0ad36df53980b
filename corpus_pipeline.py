"""A corpus from raw documents to packed training sequences, in stages that each write a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logstrata.llm import mixing, packing, pii, repetition, simhash
from logstrata.llm.common import materialize
from logstrata.llm.queries import tokenizer_path

#: SQL cannot express these stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules on repetition keep."""
    return repetition.quality_rules(docs).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text with the smallest doc_id of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Fingerprints of two-word shingles and min-hashes propose, the five-word shingles decide. A row is told by doc_id and text: rows that
    share a doc_id stay if their texts are unlike, a null doc_id comes after all others, and of rows equal in both one stays.
    """
    texts = simhash.similar_texts(docs)
    first = F.min(F.struct(F.col("first").isNull().alias("last"), "first", "h", "k")).alias("stays")
    stays = texts.groupBy("component").agg(first).select("stays.first", "stays.h", "stays.k")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), *simhash.text_hashes())
    kept = rows.alias("d").join(stays.alias("s"), (F.col("d.h") == F.col("s.h")) & (F.col("d.k") == F.col("s.k")) & F.col("id").eqNullSafe(F.col("first")), "left_semi")
    return kept.groupBy("id", "h", "k").agg(F.min("row").alias("row")).select("row.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    found = pii.find_pii(docs)
    text = F.when(F.col("text").isNotNull(), pii.redact(F.col("text"), F.col("spans")))
    changed = found.withColumn("text", text)
    return changed.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the shards they are dealt to, shuffled within each."""
    return mixing.draw(mixing.mix_documents(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack_documents(docs, tokenizer_path(), 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("PII", redact),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage{i}")
    return docs
