"""Query of language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditlake.llm import lang_id
from auditlake.llm.registry import query, table


@query("op1_lang_id")
def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = lang_id.fit(docs.where(~held & F.col("doc_id").isNotNull()), key=F.xxhash64("doc_id"))
    return lang_id.predicted(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
