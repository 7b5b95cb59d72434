"""Shared steps of the registered queries."""

from __future__ import annotations

import uuid
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditlake.functions import urls as U
from auditlake.operators import aggregates as A, broken_assets, duplicates, facts as page_facts, links, render, robots, rules, sitemaps
from auditlake.operators.audit_store import AuditStore
from auditlake.operators.shuffle import salted_join, shared_folder, stage
from auditlake.sources import tables
from auditlake.sources.versions import VersionedTable

AGENT = "SiteAuditBot/0.1 (+https://example.invalid/bot)"


def facts(spark: SparkSession, sf: str, keep_text: bool = False) -> DataFrame:
    return page_facts.page_facts(tables.fetches(spark, sf), keep_text)


def discovered(pages: DataFrame) -> DataFrame:
    """Admitted links of a crawl that includes subdomains."""
    return links.discovered_links(page_facts.page_links(pages), include_subdomains=True)


def listed(spark: SparkSession, sf: str) -> DataFrame:
    parsed = stage(sitemaps.parse_sitemaps(tables.sitemap_docs(spark, sf).where("status = 200")).drop("xml"), "sitemaps")
    return sitemaps.sitemap_urls(parsed, sitemaps.expand_sitemaps(parsed, sitemap_starts(spark, sf)))


def sitemap_starts(spark: SparkSession, sf: str) -> DataFrame:
    """Files named by robots, or the default address of sites whose robots name none."""
    declared = robots.declared_sitemaps(tables.table(spark, sf, "robots_docs"))
    sites = tables.table(spark, sf, "site_list")
    default = sites.join(declared.select("site").distinct(), "site", "left_anti").select(
        "site", F.lit(0).alias("pos"), F.concat(F.lit("https://"), "site", F.lit("/sitemap.xml")).alias("sitemap_url")
    )
    return declared.select("site", F.col("line_no").alias("pos"), "sitemap_url").unionByName(default)


def priority_flags(pages: DataFrame, priority: DataFrame) -> DataFrame:
    """Per page: ``is_priority_url`` (requested address) and ``is_priority`` (requested or final address)."""
    addresses = pages.select("page_id", F.explode(F.array(
        F.struct(F.lit(True).alias("requested"), F.col("url").alias("url")), F.struct(F.lit(False).alias("requested"), F.col("final_url").alias("url")))).alias("a"))
    hits = addresses.select("page_id", "a.*").join(priority, "url", "left_semi")
    return hits.groupBy("page_id").agg(F.max("requested").alias("is_priority_url"), F.lit(True).alias("is_priority"))


def site_signals(spark: SparkSession, sf: str, pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Per page: may it be fetched, and does its site have a sitemap."""
    verdicts = robots.robots_allowed(pages.select("page_id", "site", "url"), tables.table(spark, sf, "robots_docs"), AGENT)
    with_sitemap = sitemaps.sites_with_sitemap(sitemap).withColumn("site_has_sitemap", F.lit(True))
    joined = salted_join(verdicts, with_sitemap, ["site"], F.col("page_id"), counted=pages)
    return joined.select("page_id", (~F.col("is_allowed")).alias("is_blocked"), "site_has_sitemap")


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Where each site's crawl starts."""
    return tables.table(spark, sf, "site_list").select("site", F.concat(F.lit("https://"), "site", F.lit("/")).alias("url"))


def captures(spark: SparkSession, sf: str) -> DataFrame:
    """Captures as a browser farm delivers them."""
    return tables.table(spark, sf, "captures")


def crawl_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Fetched addresses without the HTML; a denied page has no answer."""
    rows = tables.table(spark, sf, "fetch_rows").drop("html")
    verdicts = robots.robots_allowed(rows.select("page_id", "site", "url"), tables.table(spark, sf, "robots_docs"), AGENT)
    return page_facts.without_blocked(rows, verdicts.select("page_id", (~F.col("is_allowed")).alias("is_blocked"))).drop("is_blocked")


def audit(spark: SparkSession, sf: str, pages: DataFrame) -> DataFrame:
    """The whole audit of ``pages``, a stored fact table: every joined signal, and the findings of each page.

    Every signal is worked out on narrow rows and keyed by page, so the wide facts are shuffled once, by page id.
    """
    sitemap = stage(listed(spark, sf), "listed")
    seen = site_signals(spark, sf, pages, sitemap)
    pages = stage(page_facts.without_blocked(pages, seen), "crawled")
    edges = page_facts.page_links(pages)
    targets = links.discovered_links(edges, include_subdomains=True).select(U.site_key(F.col("target")).alias("site"), F.col("target").alias("url"))
    lost = links.orphan_candidates(sitemap, targets, seeds(spark, sf)).select("site", "url")
    inner = F.size(F.filter("outlinks", lambda link: U.is_same_site(F.col("final_url"), link.target, True)))
    failures = tables.table(spark, sf, "site_signals").where("browser_unavailable").select("site", F.lit("Executable doesn't exist").alias("message"))
    true = F.lit(True)
    signals = [
        seen.select("page_id", "site_has_sitemap"),
        sitemaps.members(pages, sitemap).withColumn("in_sitemap", true),
        pages.select("page_id", "site", "url").join(lost, ["site", "url"], "left_semi").select("page_id", true.alias("is_orphan")),
        broken_assets.broken_images(pages, tables.table(spark, sf, "assets")),
        priority_flags(pages, tables.table(spark, sf, "priority_list")),
        duplicates.duplicate_counts(pages),
        render.compare_captures(pages, captures(spark, sf)),
        render.shells_without_browser(pages.select("page_id", "site", "status", "depth", inner.alias("n_internal")), failures),
    ]
    out = pages.drop("outlinks", "image_srcs")
    for signal in signals:
        out = out.join(signal, "page_id", "left")
    flags = ["site_has_sitemap", "in_sitemap", "is_orphan", "is_priority_url", "is_priority"]
    filled = {c: F.coalesce(c, F.lit(False)) for c in flags}
    filled |= {c: F.coalesce(c, F.lit(1)).cast("long") for _, c in duplicates.KEYS}
    filled["broken_images"] = F.coalesce("broken_images", F.array().cast("array<string>"))
    filled["render_unavailable"] = F.coalesce("render_unavailable", F.lit(""))
    return rules.collect_page_issues(out.withColumns(filled))


class _Crawl:
    """The crawl of one folder of tables, kept in an audit store: parsed once, audited once, read by every query."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf
        self.store = AuditStore(spark, f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}", buckets=1)
        self.parsed = self.store.parse(tables.fetches(spark, sf))

    @cached_property
    def facts(self) -> DataFrame:
        """Facts of the pages that may be fetched; of denied ones the address only."""
        pages = self.store.parsed(self.parsed).drop("print", "parsed_in")
        verdicts = robots.robots_allowed(pages.select("page_id", "site", "url"), tables.table(self.spark, self.sf, "robots_docs"), AGENT)
        return stage(page_facts.without_blocked(pages, verdicts.select("page_id", (~F.col("is_allowed")).alias("is_blocked"))), "crawled")

    @cached_property
    def audited(self) -> AuditStore:
        self.store.finish(self.parsed, lambda pages: audit(self.spark, self.sf, pages))
        return self.store

    @cached_property
    def edges(self) -> DataFrame:
        """Distinct (target, source) pairs of the links that enter the crawl."""
        return stage(links.inlink_edges(discovered(self.facts)), "edges")


@lru_cache(maxsize=4)
def _crawl(application: str, sf: str, stamp: tuple) -> _Crawl:
    return _Crawl(SparkSession.active(), sf)


def _stamp(spark: SparkSession, sf: str) -> tuple:
    """Size and time of every input file, so that changed tables are crawled anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def crawl(spark: SparkSession, sf: str) -> _Crawl:
    return _crawl(spark.sparkContext.applicationId, sf, _stamp(spark, sf))


def versioned(spark: SparkSession, name: str) -> VersionedTable:
    """A table of its own in the shared folder."""
    return VersionedTable(spark, folder(spark, name))


def folder(spark: SparkSession, name: str) -> str:
    """A new place under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def crawled(spark: SparkSession, sf: str) -> DataFrame:
    """Stored facts of the crawl, denied pages emptied."""
    return crawl(spark, sf).facts


def audited(spark: SparkSession, sf: str) -> DataFrame:
    """Stored audit of the crawl."""
    return crawl(spark, sf).audited.audited()


def page_states(spark: SparkSession, sf: str) -> DataFrame:
    return A.merged_page_states(crawl(spark, sf).audited.page_states())


def code_states(spark: SparkSession, sf: str) -> DataFrame:
    return A.merged_code_states(crawl(spark, sf).audited.code_states())


def text_of(array: str, glue: str = "|"):
    return F.array_join(array, glue)
