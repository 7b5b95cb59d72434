"""Raw against rendered captures of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from auditlake.functions import html as H
from auditlake.functions.tags import repaired
from auditlake.operators.shuffle import salted_join


def compare_captures(pages: DataFrame, captures: DataFrame) -> DataFrame:
    """``page_id, render`` of every captured page: does what a browser shows agree with the raw facts.

    ``captures``: page_id, desktop_html, mobile_match, error, mobile_error.  Whether the mobile view agrees is decided where
    both views are taken; a failed mobile view is no finding, a failed capture is one by itself.
    """
    doc = F.col("doc")
    seen = captures.withColumn("doc", repaired(H.markup(F.col("desktop_html")))).select(
        "page_id", F.col("error").alias("render_error"), "mobile_match", "mobile_error", H.title(doc).alias("r_title"),
        H.meta_content(H.open_tags(doc, "meta"), "description").alias("r_description"), H.heading_texts(doc, "h1").alias("r_h1"),
    )
    failed = F.col("render_error") != ""
    return pages.select("page_id", "title", "meta_description", "h1").join(seen, "page_id").select(
        "page_id",
        F.struct(
            F.col("render_error").alias("error"),
            (failed | (F.col("title") == F.col("r_title"))).alias("title_match"),
            (failed | (F.col("meta_description") == F.col("r_description"))).alias("description_match"),
            (failed | (F.col("h1") == F.col("r_h1"))).alias("h1_match"),
            (failed | (F.coalesce("mobile_error", F.lit("")) != "") | F.coalesce("mobile_match", F.lit(True))).alias("mobile_match"),
        ).alias("render"),
    )


def shells_without_browser(pages: DataFrame, failures: DataFrame) -> DataFrame:
    """``page_id, render_unavailable``: start pages that answer but link to nothing internal, where no browser could be started.

    ``pages``: page_id, site, status, depth, n_internal.  ``failures``: site and the browser's ``message``.
    """
    shells = pages.where("status = 200 AND depth = 0 AND n_internal = 0").select("page_id", "site")
    return salted_join(shells, failures.select("site", F.col("message").alias("render_unavailable")), ["site"], F.col("page_id"), "inner").drop("site")


def link_union(raw: DataFrame, rendered: DataFrame, last_wins: bool = False) -> DataFrame:
    """Raw and rendered links of a page, one per target.

    By default raw links stay as they are and only new rendered targets are added; with ``last_wins`` each
    target appears once, at its first place, with the attributes of its last occurrence.
    """
    both = raw.withColumn("source_no", F.lit(0)).unionByName(rendered.withColumn("source_no", F.lit(1)))
    if last_wins:
        return both.groupBy("page_id", "target").agg(
            F.min(F.struct("source_no", "link_pos")).alias("place"),
            F.max_by(F.struct("anchor_text", "rel"), F.struct("source_no", "link_pos")).alias("last"),
        ).select("page_id", "target", "place.source_no", "place.link_pos", "last.anchor_text", "last.rel")
    # every raw link stays; a rendered target counts once and only if no raw link has it
    per_target = W.partitionBy("page_id", "target").orderBy("source_no", "link_pos")
    ranked = both.withColumn("_n", F.row_number().over(per_target))
    return ranked.where("source_no = 0 OR _n = 1").drop("_n")
