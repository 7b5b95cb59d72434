"""Writers: page and issue exports, snapshots, brand runs, area reports and frontier state.

All of them write in parallel; nothing is collected.  Tables that grow with every crawl are partitioned by the key
their readers filter on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from auditlake.functions import text as X
from auditlake.functions.binding import unpack
from auditlake.operators.facts import is_indexable
from auditlake.sources.versions import VersionedTable

REPORT_URLS = 40  # fixed value: addresses listed per finding in an area report


def page_export(pages: DataFrame) -> DataFrame:
    """The page sheet: one row per page with display columns."""
    return pages.select(
        F.col("url").alias("URL"),
        F.col("status").alias("Status Code"),
        is_indexable().alias("Indexable"),
        F.col("title").alias("Title"),
        F.length("title").alias("Title Length"),
        F.col("meta_description").alias("Meta Description"),
        F.length("meta_description").alias("Meta Description Length"),
        F.array_join("h1", " | ").alias("H1"),
        F.col("canonical").alias("Canonical"),
        F.col("meta_robots").alias("Meta Robots"),
        F.col("word_count").alias("Word Count"),
        F.col("depth").alias("Depth"),
        F.size("redirect_chain").alias("Redirect Chain Length"),
        F.col("final_url").alias("Final URL"),
        F.array_join("tech", ", ").alias("Tech"),
        F.col("is_soft_404").alias("Soft 404"),
        F.bround("fetch_ms", 1).alias("Fetch Time (ms)"),
        F.size("issues").alias("Issue Count"),
        F.array_join(F.transform("issues", lambda i: F.concat(F.lit("["), i.severity, F.lit("] "), i.code)), "; ").alias("Issues"),
    )


def issue_export(pages: DataFrame) -> DataFrame:
    return unpack(pages.select(F.col("url").alias("URL"), "issues"), "issues", "i").select(
        "URL",
        F.col("i.category").alias("Category"), F.col("i.severity").alias("Severity"),
        F.col("i.code").alias("Code"), F.col("i.message").alias("Message"),
    )


def write_csv(sheet: DataFrame, path: str) -> None:
    sheet.write.mode("overwrite").option("header", True).csv(path)


def snapshot_rows(pages: DataFrame) -> DataFrame:
    """What a crawl stores for later comparison: status and sorted distinct codes per page."""
    return pages.select(
        "site", "url", "status", F.array_sort(F.array_distinct(F.transform("issues", lambda i: i.code))).alias("codes")
    )


def save_crawl(pages: DataFrame, crawls: VersionedTable, seed: str, crawl_ts: int) -> int:
    """Stores a crawl as a version: full rows with their sorted distinct codes.  Readers see it once it is complete."""
    rows = pages.withColumn("codes", F.array_sort(F.array_distinct(F.transform("issues", lambda i: i.code))))
    return crawls.write(rows.withColumn("crawl_ts", F.lit(crawl_ts)), info={"seed": seed, "crawl_ts": crawl_ts})


def save_brand_run(analyses: DataFrame, runs: VersionedTable, brand: str, run_ts: int) -> int:
    """Answers verbatim next to what was derived from them, so that parsing can be redone."""
    return runs.write(analyses.withColumn("run_ts", F.lit(run_ts)), info={"brand": brand, "run_ts": run_ts})


def brand_stats_sheet(stats: DataFrame) -> DataFrame:
    """Brand statistics per provider and intent with formatted decimals."""
    from auditlake.operators.brand import INTENT_LABELS, PROVIDER_LABELS, label_of

    return stats.select(
        label_of(F.col("provider"), PROVIDER_LABELS).alias("modelo"),
        label_of(F.col("intent"), INTENT_LABELS).alias("tipo_intent"),
        F.col("brand").alias("marca"),
        F.when(F.col("is_target"), F.lit("sí")).otherwise(F.lit("no")).alias("es_objetivo"),
        F.col("responses").alias("respuestas"),
        X.fixed_decimals(F.col("mention_rate"), 3).alias("tasa_mencion"),
        X.fixed_decimals(F.col("avg_position"), 2).alias("posicion_promedio"),
        X.fixed_decimals(F.col("share_of_voice"), 3).alias("share_of_voice"),
        X.fixed_decimals(F.col("domain_citation_rate"), 3).alias("tasa_cita_dominio"),
        *[X.fixed_decimals(F.col(f"framing_{f}"), 3).alias(f"framing_{f}") for f in X.FRAMINGS],
    )


def area_report(issues: DataFrame) -> DataFrame:
    """Per site, category and code: the first addresses, how many more there are, and the block's place."""
    from auditlake.operators.aggregates import truncated

    listed = truncated(issues, ["site", "category", "code"], ["page_id", "issue_seq"], REPORT_URLS)
    return listed.select("site", "category", "code", "severity", "row_no", "url", F.col("group_rows").alias("affected"), "overflow")


def write_area_reports(report: DataFrame, reports: VersionedTable) -> int:
    """One part per category, so that a reader of one area opens its part only."""
    return reports.write(report.withColumn("area", F.col("category")), "area")


def save_frontier(frontier: DataFrame, frontiers: VersionedTable, saved_at: int) -> int:
    """Writes a frontier as the newest version; a crash before its record leaves the one before.

    ``frontiers.read()`` resumes from it, ``frontiers.clear()`` removes all once a crawl has completed.
    """
    return frontiers.write(frontier, info={"saved_at": saved_at})
