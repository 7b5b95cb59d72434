"""The training-data pipeline: five stages over ``documents``, each a Spark job whose result is written before the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir).  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from auditlake.llm import jaccard_join, packing, quality_rules, secret_scan, substring_dedup
from auditlake.llm.names import free
from auditlake.operators.shuffle import stage

#: The forest of the secret scan and the packing order can't be written as SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the threshold table."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each similarity class; a row that repeats id and text stays once.

    Rows without id belong to no class and stay, one of each text.
    """
    key = free(docs, "_hash")
    classes = jaccard_join.similarity_classes(docs.select("doc_id", "text"), hashed=True)
    later = classes.where("doc_id != component_id").select("doc_id", F.col("hash").alias(key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64("text"))
    return keyed.join(later, ["doc_id", key], "left_anti").dropDuplicates(["doc_id", "text"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that an earlier document has; a text of which nothing is left goes."""
    key, left = free(docs, "_hash"), free(docs, "_left")
    spans = substring_dedup.repeated_spans(docs.select("doc_id", "text"), text=True).where("n_removed > 0").dropDuplicates(["doc_id", "hash"])
    spans = spans.select("doc_id", F.col("hash").alias(key), F.col("kept").alias(left))
    out = docs.withColumn(key, F.xxhash64("text")).join(spans, ["doc_id", key], "left").where(F.col(left).isNull() | (F.col(left) != ""))
    out = out.withColumn("text", F.coalesce(left, "text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced; no document goes."""
    return secret_scan.redacted(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences for training, as pieces with their ids."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality_rules", quality), ("jaccard_join", near_duplicates), ("substring_dedup", repeated_passages), ("secret_scan", secrets), ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
