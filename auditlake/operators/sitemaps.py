"""Sitemap files: locations, index expansion, membership and site findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from auditlake.functions import html as H, urls as U
from auditlake.functions.binding import unpack
from auditlake.operators.shuffle import cut_lineage


def root_tag(xml: Column) -> Column:
    """Local name of the document element, empty when the text is not a closed XML element."""
    root = F.regexp_extract(xml, r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->|<![A-Z][^>]*>)*<(?:[\w.\-]+:)?([\w.\-]+)[\s>]", 1)
    closed = F.regexp_extract(xml, r"</(?:[\w.\-]+:)?([\w.\-]+)\s*>\s*$", 1)
    return F.when(root == closed, root).otherwise(F.lit(""))


def _locs(xml: Column, element: str) -> Column:
    entries = F.regexp_extract_all(xml, F.lit(rf"(?s)<(?:\w+:)?{element}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{element}\s*>"), F.lit(1))
    locs = F.transform(
        entries,
        lambda e: H.trim_ws(H.decode_entities(F.regexp_extract(e, r"(?s)<(?:\w+:)?loc(?:\s[^>]*)?>(.*?)</(?:\w+:)?loc\s*>", 1))),
    )
    return F.filter(locs, lambda l: l != "")


def parse_sitemaps(docs: DataFrame) -> DataFrame:
    """Adds ``is_index``, ``parse_error`` and ``locs`` (child files of an index, addresses of a urlset)."""
    root = docs.withColumn("root", root_tag(F.col("xml")))
    locs = F.when(F.col("root") == "sitemapindex", _locs(F.col("xml"), "sitemap")).when(
        F.col("root") == "urlset", _locs(F.col("xml"), "url")
    )
    error = F.when(F.col("root") == "", F.lit("XML no válido")).when(
        ~F.col("root").isin("sitemapindex", "urlset"), F.concat(F.lit("Elemento raíz inesperado: <"), "root", F.lit(">"))
    )
    return root.select(
        *docs.columns,
        (F.col("root") == "sitemapindex").alias("is_index"),
        F.coalesce(error, F.lit("")).alias("parse_error"),
        F.coalesce(locs, F.array().cast("array<string>")).alias("locs"),
    )


def expand_sitemaps(parsed: DataFrame, starts: DataFrame, max_documents: int | None = None) -> DataFrame:
    """Reads each site's sitemap files breadth first, every file once, all of them or at most ``max_documents`` per site.

    ``parsed``: the stored result of ``parse_sitemaps`` for the files that answered 200; every round reads it.
    ``starts``: site, pos, sitemap_url.  Returns the files visited with their visit number.  One round per index
    level; files already visited are left out, so cycles end.
    """
    children = parsed.where("is_index").select("site", F.col("sitemap_url").alias("parent"), "locs")
    children = unpack(children, "locs", "sitemap_url", "child_pos").drop("locs")
    queue = starts.select("site", F.lit(0).alias("parent_no"), F.col("pos").alias("child_pos"), "sitemap_url")
    visited = None
    while True:
        fresh = queue.groupBy("site", "sitemap_url").agg(F.min(F.struct("parent_no", "child_pos")).alias("place"))
        if visited is None:
            seen = fresh.withColumn("already", F.lit(0))
        else:
            fresh = fresh.join(visited, ["site", "sitemap_url"], "left_anti")
            seen = fresh.join(visited.groupBy("site").agg(F.count("*").alias("already")), "site")
        turn = F.row_number().over(W.partitionBy("site").orderBy("place"))
        level = seen.withColumn("visit_no", (turn + F.col("already")).cast("int"))
        if max_documents is not None:
            level = level.where(F.col("visit_no") <= max_documents)
        level = cut_lineage(level.select("site", "sitemap_url", "visit_no"))
        if visited is not None and level.isEmpty():
            return visited
        visited = level if visited is None else visited.unionByName(level)
        queue = children.join(
            level.select("site", F.col("sitemap_url").alias("parent"), F.col("visit_no").alias("parent_no")), ["site", "parent"]
        ).select("site", "parent_no", "child_pos", "sitemap_url")


def sitemap_urls(parsed: DataFrame, visited: DataFrame) -> DataFrame:
    """Addresses collected from the visited urlset files, in reading order."""
    files = parsed.where("NOT is_index")
    entries = visited.join(files, ["site", "sitemap_url"]).select("site", "visit_no", "sitemap_url", "locs")
    return unpack(entries, "locs", "loc", "loc_pos").drop("locs")


def members(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """Ids of the pages that are listed by their requested or final address.

    Each page contributes its two addresses as narrow rows; the address is part of the key, so nothing is skewed.
    """
    final = F.when(F.col("final_url") == "", F.col("url")).otherwise(F.col("final_url"))
    addresses = pages.select("page_id", "site", F.explode(F.array_distinct(F.array("url", final))).alias("loc"))
    entries = listed.select("site", U.strip_fragment(F.col("loc")).alias("loc"))
    return addresses.join(entries, ["site", "loc"], "left_semi").select("page_id").distinct()


def sites_with_sitemap(listed: DataFrame) -> DataFrame:
    return listed.select("site").distinct()


def crawled_addresses(pages: DataFrame) -> DataFrame:
    address = F.when(F.col("final_url") == "", F.col("url")).otherwise(F.col("final_url"))
    return pages.where("status IS NOT NULL").select("site", address.alias("loc"), "status", "page_id")


def listed_status(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """Status of every listed address as the crawl saw it; unknown addresses count as fine."""
    known = crawled_addresses(pages).groupBy("site", "loc").agg(F.max_by("status", "page_id").alias("status"))
    return listed.join(known, ["site", "loc"], "left").withColumn("status", F.coalesce("status", F.lit(200)))


def missing_from_sitemap(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """Crawled addresses that no file of the site lists (raw addresses, as listed)."""
    return crawled_addresses(pages).select("site", "loc").distinct().join(
        listed.select("site", "loc").distinct(), ["site", "loc"], "left_anti"
    )
