"""Duplicate groups.  A group of copies may be a third of a crawl, so members stay rows: they are never gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from auditlake.operators.shuffle import salted_join


def group_sizes(pages: DataFrame, key: str) -> DataFrame:
    """Number of 200-status pages per site and non-empty key; only repeated keys.  Partial counts run map-side."""
    usable = pages.where((F.col("status") == 200) & (F.col(key) != ""))
    return usable.groupBy("site", key).agg(F.count("*").alias("group_size")).where("group_size > 1")


def duplicate_groups(pages: DataFrame, key: str) -> DataFrame:
    """Members of every duplicate group, one row each, with the size of the group."""
    usable = pages.where((F.col("status") == 200) & (F.col(key) != "")).select("page_id", "site", "url", key)
    return salted_join(usable, group_sizes(pages, key), ["site", key], F.col("page_id"), "inner")


KEYS = (("content_hash", "same_content"), ("title", "same_title"), ("meta_description", "same_meta"))


def duplicate_counts(pages: DataFrame) -> DataFrame:
    """Per page: how many pages of its site share its content, title and description, itself included.

    The three keys of a page become three narrow rows, so one count, one join and one regrouping serve them all and
    no wide page row is shuffled.  Only repeated keys are joined back.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("key")) for i, (k, _) in enumerate(KEYS)])
    narrow = pages.where("status = 200").select("page_id", "site", F.explode(keys).alias("k")).select("page_id", "site", "k.*").where("key <> ''")
    sizes = narrow.groupBy("site", "kind", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = salted_join(narrow, sizes, ["site", "kind", "key"], F.col("page_id"), "inner")
    return shared.groupBy("page_id").agg(*[F.max(F.when(F.col("kind") == i, F.col("n"))).alias(name) for i, (_, name) in enumerate(KEYS)])


def with_duplicate_counts(pages: DataFrame) -> DataFrame:
    """Adds ``same_content``, ``same_title``, ``same_meta``; 1 where nothing is shared."""
    counted = pages.join(duplicate_counts(pages), "page_id", "left")
    return counted.withColumns({name: F.coalesce(name, F.lit(1)).cast("long") for _, name in KEYS})
