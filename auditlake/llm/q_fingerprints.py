"""Query of the document fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm import imatch
from auditlake.llm.registry import query, table


@query("op6_imatch")
def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compared(table(spark, sf_dir, "documents"))
