"""Crawl history: snapshots, the previous crawl of each, differences and the cross-site feed.

A snapshot is rows (site, crawl_ts, url, codes); all joins include the address, so no site is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from auditlake.operators.shuffle import running_before, salted_join


def snapshot_pages(codes: DataFrame, ts: str = "crawl_ts") -> DataFrame:
    """One row per page of a crawl with its sorted distinct codes (a page has a bounded number of codes)."""
    return codes.groupBy("site", F.col(ts).alias("crawl_ts"), "url").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def crawls(pages: DataFrame) -> DataFrame:
    """One row per crawl with its neighbours in time: the as-of lookup of the previous snapshot."""
    by_site = W.partitionBy("site").orderBy("crawl_ts")
    each = pages.groupBy("site", "crawl_ts").agg(F.count("*").alias("page_count"))
    return each.withColumn("previous_ts", F.lag("crawl_ts").over(by_site)).withColumn("next_ts", F.lead("crawl_ts").over(by_site))


def previous_snapshot(requests: DataFrame, pages: DataFrame, width: float = 4096) -> DataFrame:
    """Latest snapshot strictly before each request (site, before_ts): one scan over crawls and requests.

    Requests and crawls are unioned and the last crawl time is carried forward, so no pair is ever formed.  A site's times
    are cut into blocks of ``width``, so a site of any size is scanned by many tasks.
    """
    events = pages.select("site", F.col("crawl_ts").alias("at"), F.col("crawl_ts").alias("seen"), F.lit(1).alias("kind")).distinct().unionByName(
        requests.select("site", F.col("before_ts").alias("at"), F.lit(None).cast("long").alias("seen"), F.lit(0).alias("kind")).distinct()
    )
    found = running_before(events, "site", ["at", "kind"], F.floor(F.col("at") / width), F.col("seen"), "max", "previous_ts").where("kind = 0")
    return found.select("site", F.col("at").alias("before_ts"), "previous_ts")


def diff(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer comparison by address: codes that appeared and that were resolved, pages new and gone."""
    none = F.array().cast("array<string>")
    a = previous.select(*keys, F.col("codes").alias("was"))
    b = current.select(*keys, F.col("codes").alias("now"))
    both = a.join(b, keys, "full")
    return both.select(
        *keys,
        F.array_sort(F.array_except(F.coalesce("now", none), F.coalesce("was", none))).alias("new_codes"),
        F.array_sort(F.array_except(F.coalesce("was", none), F.coalesce("now", none))).alias("resolved_codes"),
        F.col("was").isNull().alias("page_added"),
        F.col("now").isNull().alias("page_removed"),
    )


def consecutive_diffs(pages: DataFrame) -> DataFrame:
    """Difference of every crawl against the one before it, for all sites at once."""
    times = crawls(pages).select("site", "crawl_ts", "previous_ts", "next_ts")
    timed = salted_join(pages, times, ["site", "crawl_ts"], F.col("url"), "inner")
    current = timed.where("previous_ts IS NOT NULL").select("site", "previous_ts", "crawl_ts", "url", "codes")
    previous = timed.where("next_ts IS NOT NULL").select("site", F.col("crawl_ts").alias("previous_ts"), F.col("next_ts").alias("crawl_ts"), "url", "codes")
    return diff(previous, current, ["site", "previous_ts", "crawl_ts", "url"])


def diff_summary(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("site", "previous_ts", "crawl_ts").agg(
        F.sum(F.size("new_codes")).alias("new_issue_count"),
        F.sum(F.size("resolved_codes")).alias("resolved_issue_count"),
        F.count_if("page_added").alias("new_pages"),
        F.count_if("page_removed").alias("removed_pages"),
    ).withColumn(
        "is_empty",
        (F.col("new_issue_count") == 0) & (F.col("resolved_issue_count") == 0) & (F.col("new_pages") == 0) & (F.col("removed_pages") == 0),
    )


def latest_full(catalog: DataFrame, key: str = "site") -> DataFrame:
    """Newest crawl with full pages per site: an aggregate, not a sort of the whole history."""
    return catalog.where("has_full").groupBy(key).agg(F.max(F.struct("crawl_ts", "page_count")).alias("latest")).select(key, "latest.*")
