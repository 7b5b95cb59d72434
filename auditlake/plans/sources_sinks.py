"""Source and sink queries: stored formats are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from auditlake.operators import brand as B
from auditlake.operators.rules import lookup
from auditlake.operators.shuffle import number_within, shared_folder
from auditlake.plans import duck as D, inputs as I
from auditlake.plans.brand import BRANDS
from auditlake.plans.history import _codes
from auditlake.plans.registry import query
from auditlake.sources import readers, sinks
from auditlake.sources.tables import AS_OF_EPOCH, table

u = F.col


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _snapshot_files(spark, sf) -> str:
    """Snapshot documents, one JSON object per crawl, with full pages on two days of three.

    A document holds a bounded number of pages: crawls are cut into blocks of five hundred users.
    """
    rows = _codes(spark, sf).groupBy("site", "crawl_ts", "url").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    host = F.concat(F.lit("https://s"), u("site").cast("string"), F.lit(".example.com/"))
    issue = lambda c: F.array(F.lit("meta"), F.lit("info"), c, F.lit(""))
    full = F.struct("url", F.lit(200).alias("status_code"), F.transform("codes", issue).alias("issues"), F.array(F.array(u("url"), F.lit("301"))).alias("redirect_chain"))
    block = F.floor(F.regexp_extract("url", "([0-9]+)", 1).cast("long") / 10000)
    docs = rows.groupBy("site", "crawl_ts", block.alias("block")).agg(
        F.map_from_entries(F.collect_list(F.struct("url", "codes"))).alias("pages"),
        F.map_from_entries(F.collect_list(F.struct("url", F.lit(200)))).alias("status_by_url"),
        F.collect_list(full).alias("full"),
    )
    path = _folder(spark, "snapshot-files")
    docs.select(
        host.alias("seed_url"), u("crawl_ts").cast("double").alias("timestamp"), "pages", "status_by_url",
        F.when(u("crawl_ts") % 3 != 0, u("full")).alias("pages_full"),
    ).write.json(path)
    return path


@query("snapshot_catalog", """
SELECT 'https://s' || site || '.example.com/' AS seed_url, crawl_day::double AS crawl_ts, count(DISTINCT url) AS page_count, crawl_day % 3 <> 0 AS has_full FROM snapshots GROUP BY site, crawl_day, cast(substr(url, 3) AS bigint) // 10000""")
def snapshot_catalog(spark, sf):
    return readers.snapshot_catalog(readers.read_snapshots(spark, _snapshot_files(spark, sf))).drop("path")


@query("snapshot_load", """
SELECT 's' || site || '.example.com' AS site, crawl_day::double AS crawl_ts, url, string_agg(code, ',' ORDER BY code) AS codes, CASE WHEN crawl_day % 3 <> 0 THEN count(*) END AS full_issues FROM snapshots GROUP BY site, crawl_day, url""")
def snapshot_load(spark, sf):
    """Codes of every page, and the number of findings where full pages were stored."""
    snapshots = readers.read_snapshots(spark, _snapshot_files(spark, sf))
    codes = readers.snapshot_codes(snapshots).select("site", "crawl_ts", "url", F.array_join("codes", ",").alias("codes"))
    full = readers.full_pages(snapshots).select(
        F.regexp_extract("seed_url", "//([^/]*)", 1).alias("site"), "crawl_ts", "url", F.size("issues").cast("long").alias("full_issues"))
    return codes.join(full, ["site", "crawl_ts", "url"], "left")


@query("brand_runs_load", """
SELECT 'Thing' AS target, (r.resp_id // 16)::double AS created_at, row_number() OVER (PARTITION BY r.resp_id // 16 ORDER BY r.resp_id) - 1 AS answer_no, r.provider, r.query, r.intent, r.repetition, r.web_search, r.text, r.error,
  coalesce((SELECT string_agg(m.brand || ':' || m.position, ',' ORDER BY m.position) FROM mention_rows m WHERE m.resp_id = r.resp_id), '') AS mentions, CASE WHEN r.resp_id % 2 = 0 THEN 'positivo' ELSE 'neutro' END AS tone FROM responses r""")
def brand_runs_load(spark, sf):
    """Runs written as indented documents, many to a file, and read back answer by answer."""
    analyses = B.with_mentions(table(spark, sf, "responses"), BRANDS)
    response = F.struct("provider", "query", "intent", u("repetition").cast("int").alias("repetition"), "web_search", F.lit(0.7).alias("temperature"), "text", "error", F.lit(0.0).alias("timestamp"))
    # a run holds a bounded number of answers: sixteen here
    rows = F.sort_array(F.collect_list(F.struct("resp_id", response.alias("response"), "mentions")))
    runs = analyses.withColumn("run", F.floor(u("resp_id") / 16)).groupBy("run").agg(rows.alias("rows"))
    tone = lambda r: F.create_map(F.lit("Thing"), F.when(r.resp_id % 2 == 0, F.lit("positivo")).otherwise(F.lit("neutro")))
    answers = F.transform("rows", lambda r: F.struct(r.response.alias("response"), r.mentions.alias("mentions"), tone(r).alias("framing")))
    document = F.struct(u("run").cast("double").alias("created_at"), F.struct(F.struct(F.lit("Thing").alias("name")).alias("target")).alias("config"), answers.alias("analyses"))
    path = _folder(spark, "brand-runs")
    runs.select(F.to_json(document, {"pretty": "true"}).alias("value")).write.option("lineSep", readers.RECORD_SEPARATOR).text(path)
    shown = F.array_join(F.transform("mentions", lambda m: F.concat(m.brand, F.lit(":"), m.position.cast("string"))), ",")
    return readers.read_brand_runs(spark, path).select(
        "target", "created_at", "answer_no", "provider", "query", "intent", "repetition", "web_search", "text", "error", shown.alias("mentions"), u("framing")["Thing"].alias("tone"))


D.CTES["heads"] = r"SELECT doc_id, coalesce(lang, '') AS lang, regexp_replace(replace(replace(coalesce(text, ''), '<', ''), '&', ''), '\s+$', '') AS head FROM documents"


@query("feed_items", """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos, title, link, source, source_domain, published_at FROM (
  SELECT doc_id, 1 AS n, trim('SEO y ' || head) AS title, 'https://n.example/' || doc_id AS link, 'Diario' AS source, 'diario.example.' || lang AS source_domain, 'Mon, ' || (1 + doc_id % 28) || ' Jan 2024 10:00:00 GMT' AS published_at FROM heads
  UNION ALL SELECT doc_id, 2, 'Motores de Búsqueda: ' || doc_id, 'https://n.example/m', '', '', 'ayer' FROM heads UNION ALL SELECT doc_id, 3, 'LLM & buscadores', 'https://n.example/l', 'Solo', '', '' FROM heads)""")
def feed_items(spark, sf):
    return readers.feed_items(table(spark, sf, "feed_docs"))


@query("psi_metrics", """
SELECT page_id, CASE WHEN page_id % 10 < 8 THEN (page_id * 7) % 100 END AS score, CASE WHEN page_id % 10 < 9 THEN (1000 + page_id % 3000 + 0.5)::double END AS lcp_ms, CASE WHEN page_id % 10 < 9 THEN ('0.' || (page_id % 9))::double END AS cls,
  CASE WHEN page_id % 10 < 9 THEN length(html)::double END AS fcp_ms, CASE WHEN page_id % 10 < 9 AND page_id % 2 = 0 THEN 12.0::double END AS tbt_ms FROM pages""")
def psi_metrics(spark, sf):
    return readers.speed_metrics(table(spark, sf, "psi_payloads"))


@query("resumable_crawls", f"SELECT seed_url, pages_done, pending, saved_at, {AS_OF_EPOCH} - saved_at AS age_seconds FROM saved_frontiers WHERE pending > 0 AND {AS_OF_EPOCH} - saved_at <= 604800 ORDER BY saved_at DESC")
def resumable_crawls(spark, sf):
    saved = table(spark, sf, "saved_frontiers").withColumn("frontier", F.when(u("pending") > 0, F.sequence(F.lit(1), u("pending"))).otherwise(F.array().cast("array<bigint>")))
    return readers.resumable(saved, F.lit(AS_OF_EPOCH)).drop("frontier")


@query("frontier_state", "SELECT seed_url, pending, saved_at FROM saved_frontiers")
def frontier_state(spark, sf):
    """Saved twice, old versions cleared, read from the newest."""
    frontiers, rows = I.versioned(spark, "frontiers"), table(spark, sf, "saved_frontiers").select("seed_url", "pending", "saved_at")
    sinks.save_frontier(rows.where("pending = 0"), frontiers, AS_OF_EPOCH - 60)
    sinks.save_frontier(rows, frontiers, AS_OF_EPOCH)
    frontiers.clear(keep=1)
    return frontiers.read()


@query("channel_history", """
SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3 ORDER BY conv_id, turn""")
def channel_history(spark, sf):
    """The last messages of every channel, oldest first: a top-k per channel, limited before the shuffle."""
    from pyspark.sql import Window as W

    last = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf, "conversations").withColumn("n", last).where("n <= 3").drop("n").orderBy("conv_id", "turn")


@query("fetch_schedule", "SELECT event_id, host, slot, slot / 4.0::double AS start_at FROM (SELECT event_id, host, row_number() OVER (PARTITION BY host ORDER BY event_id) - 1 AS slot FROM fetch_log)")
def fetch_schedule(spark, sf):
    """Even spacing of each host's requests at four per second.  Numbering runs per block of ids, so a host that
    holds a third of all requests is not sorted in one task."""
    log = table(spark, sf, "fetch_log").select("event_id", "host")
    numbered = number_within(log, "host", ["event_id"], F.floor(u("event_id") / 4096), "slot_no")
    return numbered.select("event_id", "host", (u("slot_no") - 1).alias("slot"), ((u("slot_no") - 1) / F.lit(4.0)).alias("start_at"))


STATUSES = ["Por hacer", "En progreso", "Revisión cliente", "Hecho"]  # fixed values
IMPACTS = {"critical": "alto", "warning": "medio", "info": "bajo"}  # fixed values


@query("backlog_status", """
SELECT s.status, count(b.event_id) AS items, coalesce(count_if(b.severity = 'critical'), 0)::bigint AS alto, coalesce(count_if(b.severity NOT IN ('critical', 'info')), 0)::bigint AS medio, coalesce(count_if(b.severity = 'info'), 0)::bigint AS bajo
FROM (VALUES ('Por hacer'), ('En progreso'), ('Revisión cliente'), ('Hecho')) s(status) LEFT JOIN backlog b ON b.status = s.status GROUP BY s.status""")
def backlog_status(spark, sf):
    """Work items per status with their impact; statuses without items stay."""
    impact = F.coalesce(lookup(u("severity"), IMPACTS), F.lit("medio"))
    counts = table(spark, sf, "backlog").withColumn("impact", impact).groupBy("status").agg(
        F.count("*").alias("items"), *[F.count_if(u("impact") == i).alias(i) for i in ("alto", "medio", "bajo")])
    statuses = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    return statuses.join(counts, "status", "left").fillna(0)
