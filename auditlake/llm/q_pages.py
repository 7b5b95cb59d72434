"""Queries over ``pages``: WARC archives and URL filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditlake.llm import url_filter, warc
from auditlake.llm.registry import query, table


@query("op9_warc")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives are written and read back; digests of responses are those of the bytes read, not those of the header."""
    manifest = warc.write(warc.chunked(warc.revisits(table(spark, sf_dir, "pages"))))
    last = warc.read(manifest, with_data=False).where("last")
    revisit = F.col("record_type") == "revisit"
    return last.select(
        "page_id", F.when(revisit, F.col("payload_bytes")).otherwise(F.col("n_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"), "record_type", "refers_to",
    )


@query("op3_url_filter")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document with its id: bad if toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    labelled = pages.join(labels, pages.page_id == labels.doc_id).select("url", bad.alias("bad"))
    return url_filter.judged(pages, labelled).select("page_id", "host", "path", "rule", "verdict")
