"""Readers of the stored formats: crawl snapshots, brand runs, saved frontiers, feeds and speed reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditlake.functions import html as H, text as X, urls as U
from auditlake.functions.binding import unpack
from auditlake.sources.versions import VersionedTable

SNAPSHOT_SCHEMA = (
    "seed_url string, timestamp double, pages map<string,array<string>>, status_by_url map<string,int>, "
    "site_issues array<array<string>>, pages_full array<struct<url:string,status_code:int,final_url:string,"
    "redirect_chain:array<array<string>>,content_type:string,depth:int,fetch_time_ms:double,title:string,"
    "meta_description:string,h1:array<string>,h2:array<string>,canonical:string,meta_robots:string,x_robots_tag:string,"
    "word_count:int,inlinks:array<string>,content_hash:string,is_soft_404:boolean,is_orphan:boolean,in_sitemap:boolean,"
    "meta_keywords:string,images_without_alt:int,empty_anchors:int,keywords:array<string>,tech:array<string>,error:string,"
    "issues:array<array<string>>>>"
)
RUN_SCHEMA = (
    "created_at double, config struct<target:struct<name:string,domain:string,aliases:array<string>>,"
    "competitors:array<struct<name:string,domain:string,aliases:array<string>>>,category:string,market:string,"
    "providers:array<string>,repetitions:int,temperature:double,paraphrase_provider:string>, "
    "analyses array<struct<response:struct<provider:string,query:string,intent:string,repetition:int,web_search:boolean,"
    "temperature:double,text:string,error:string,timestamp:double>,"
    "mentions:array<struct<brand:string,position:int,is_domain_citation:boolean>>,framing:map<string,string>>>"
)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot files, one JSON object per line; unreadable ones are dropped."""
    return spark.read.schema(SNAPSHOT_SCHEMA).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path).select(
        "*", F.col("_metadata.file_path").alias("path")
    )


def snapshot_codes(snapshots: DataFrame) -> DataFrame:
    """(site, crawl_ts, url, status, codes) of every page of every snapshot."""
    return snapshots.select(
        U.host_slug(F.col("seed_url")).alias("site"), F.col("timestamp").alias("crawl_ts"), "status_by_url", F.explode("pages").alias("url", "codes")
    ).select("site", "crawl_ts", "url", F.try_element_at("status_by_url", F.col("url")).alias("status"), "codes")


def _issues(raw: Column) -> Column:
    return F.transform(raw, lambda i: F.struct(i[0].alias("category"), i[1].alias("severity"), i[2].alias("code"), i[3].alias("message")))


def full_pages(snapshots: DataFrame) -> DataFrame:
    """Complete page rows of the snapshots that stored them."""
    rows = snapshots.where(F.size("pages_full") > 0).select("seed_url", F.col("timestamp").alias("crawl_ts"), F.explode("pages_full").alias("p"))
    return rows.select("seed_url", "crawl_ts", "p.*").withColumns(
        {
            "issues": _issues(F.col("issues")),
            "redirect_chain": F.transform("redirect_chain", lambda h: F.struct(h[0].alias("url"), h[1].cast("int").alias("status"))),
        }
    )


def snapshot_catalog(snapshots: DataFrame) -> DataFrame:
    """Metadata of every stored crawl, newest first; only the needed columns are parsed."""
    return snapshots.select(
        "path", "seed_url", F.col("timestamp").alias("crawl_ts"),
        F.size(F.map_keys("pages")).alias("page_count"), F.coalesce(F.size("pages_full") > 0, F.lit(False)).alias("has_full"),
    ).orderBy(F.desc("crawl_ts"))


RECORD_SEPARATOR = "\u001e"


def read_brand_runs(spark: SparkSession, path: str) -> DataFrame:
    """Brand runs (indented JSON documents) as answer rows with the stored analysis.

    A file holds one document, or any number of them with a record separator between: a control character, which JSON
    never holds unescaped.
    """
    runs = spark.read.schema(RUN_SCHEMA).option("lineSep", RECORD_SEPARATOR).option("recursiveFileLookup", "true").json(path)
    return brand_answers(runs)


def list_runs(runs: VersionedTable, brand: str | None = None) -> list[dict]:
    """Records of stored runs, oldest first: version, brand and time.  One record a run, no rows are read."""
    found = [{"version": r["version"], **r["info"]} for r in runs.versions()]
    return sorted((r for r in found if brand in (None, r["brand"])), key=lambda r: (r["run_ts"], r["version"]))


def brand_answers(runs: DataFrame) -> DataFrame:
    """Answer rows of stored runs."""
    rows = runs.select(F.col("config.target.name").alias("target"), "created_at", "analyses")
    return unpack(rows, "analyses", "a", "answer_no").select("target", "created_at", "answer_no", "a.response.*", "a.mentions", "a.framing")


MAX_AGE_SECONDS = 7 * 24 * 3600  # fixed value: older frontiers are not resumed


def resumable(saved: DataFrame, as_of: Column) -> DataFrame:
    """Unfinished crawls that are still fresh, newest first.  ``saved``: seed_url, frontier, saved_at (epoch)."""
    age = as_of - F.col("saved_at")
    return saved.where((F.size("frontier") > 0) & (age <= MAX_AGE_SECONDS)).withColumn("age_seconds", age).orderBy(F.desc("saved_at"))


def feed_items(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Relevant items of RSS documents in document order, all or at most ``limit`` per document."""
    items = F.regexp_extract_all("xml", F.lit(r"(?s)<item(?:\s[^>]*)?>(.*?)</item\s*>"), F.lit(1))

    def field(item: Column, tag: str) -> Column:
        return H.trim_ws(H.decode_entities(F.regexp_extract(item, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)))

    parsed = F.transform(
        items,
        lambda i: F.struct(
            field(i, "title").alias("title"),
            field(i, "link").alias("link"),
            field(i, "source").alias("source"),
            U.authority(H.attr(F.regexp_extract(i, r"(<source(?:\s[^>]*)?>)", 1), "url")).alias("source_domain"),
            field(i, "pubDate").alias("published_at"),
        ),
    )
    kept = F.filter(parsed, lambda i: (i.title != "") & (i.link != "") & X.is_relevant(i.title))
    return unpack(docs.select("doc_id", (kept if limit is None else F.slice(kept, 1, limit)).alias("items")), "items", "item", "pos").select("doc_id", "pos", "item.*")


def speed_metrics(payloads: DataFrame) -> DataFrame:
    """Flat metrics of page-speed reports; missing audits are NULL."""
    audit = lambda name: F.get_json_object("payload", f"$.lighthouseResult.audits['{name}'].numericValue").try_cast("double")
    score = F.get_json_object("payload", "$.lighthouseResult.categories.performance.score").try_cast("double")
    return payloads.select(
        "page_id",
        F.bround(score * 100, 0).cast("long").alias("score"),
        audit("largest-contentful-paint").alias("lcp_ms"),
        audit("cumulative-layout-shift").alias("cls"),
        audit("first-contentful-paint").alias("fcp_ms"),
        audit("total-blocking-time").alias("tbt_ms"),
    )
