"""Queries of the similarity join and of substring dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import jaccard_join, substring_dedup
from auditlake.llm.registry import query, table


@query("op4_jaccard_join")
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_classes(table(spark, sf_dir, "documents"))


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("hash")
