"""Query of the secret scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditlake.llm import secret_scan
from auditlake.llm.registry import query, table


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate; the value itself is shown by its digest only."""
    found = secret_scan.findings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")
