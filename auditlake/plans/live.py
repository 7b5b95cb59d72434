"""Streaming queries: the event table is read as a stream to its end, and the resulting table is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from auditlake.operators import brand as B
from auditlake.operators.shuffle import shared_folder
from auditlake.plans import duck as D
from auditlake.plans.brand import BRANDS
from auditlake.plans.registry import query
from auditlake.streaming import changes as C, pages as S

u = F.col
FILES = 64  # files in a micro-batch: bounds its rows whatever has piled up
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def _stream(spark, sf: str, name: str, schema: str) -> DataFrame:
    """One of the supplied tables as a file stream.

    A table is a file or a folder of files: the pattern fits its own name only, and a path with a pattern may end in either.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{sf}/{name}.parque[t]")


def _folders(spark, name: str) -> tuple[str, str]:
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{root}/table", f"{root}/progress"


def _fetches(spark, sf: str) -> DataFrame:
    """Page records as they come in: an address is fetched again and again."""
    events = _stream(spark, sf, "events", EVENTS)
    return events.select(
        F.concat(F.lit("/u"), u("user_id").cast("string"), F.lit("/"), (u("event_id") % 7).cast("string")).alias("url"),
        (u("user_id") % 20).alias("site"), "event_id", "ts", F.when(u("event_type") == "error", F.lit(500)).when(u("event_type") == "signup", F.lit(None)).otherwise(F.lit(200)).alias("status"),
        F.concat(F.lit("h"), (u("user_id") % 20).cast("string")).alias("host"), F.floor(F.unix_micros("ts") / 1000000).alias("unix_ts"), "event_type", "value",
    )


def _kept(spark, rows: DataFrame, name: str, merge, partial=None) -> DataFrame:
    """Follows a stream to its end into a change table and reads it back; ``partial`` reduces a micro-batch first."""
    path, progress = _folders(spark, name)
    changes = C.ChangeTable(spark, path, merge)
    put = changes.put if partial is None else lambda batch, number: changes.put(partial(batch), number)
    rows.writeStream.foreachBatch(put).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return changes.read()


@query("stream_upsert", """
SELECT '/u' || user_id || '/' || (event_id % 7) AS url, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY url""")
def stream_upsert(spark, sf):
    pages = _fetches(spark, sf).select("url", "event_id", "event_type", "value")
    return _kept(spark, pages, "upsert", C.latest(["url"], "event_id"))


_COUNTS = """
SELECT user_id % 20 AS site, count(*) AS pages, count_if(event_type IN ('error', 'signup'))::bigint AS error_pages, count_if(event_type NOT IN ('error', 'signup'))::bigint AS ok_pages FROM events GROUP BY 1"""


_COUNTED = C.totals(["site"], ["pages", "error_pages", "ok_pages"])


@query("stream_counts", _COUNTS)
def stream_counts(spark, sf):
    return _kept(spark, _fetches(spark, sf), "counts", _COUNTED, S.running_counts)


@query("stream_progress", f"SELECT site, pages, least(500, greatest(CASE WHEN site % 3 = 0 THEN 500 ELSE 40 * site END, pages))::bigint AS estimate FROM ({_COUNTS})")
def stream_progress(spark, sf):
    """Size estimate from the running counters; every third site has no sitemap."""
    counts = _kept(spark, _fetches(spark, sf), "progress", _COUNTED, S.running_counts)
    sitemap = F.when(u("site") % 3 == 0, F.lit(0)).otherwise(u("site") * 40)
    return counts.select("site", "pages", S.estimated_total(u("pages"), sitemap).cast("long").alias("estimate"))


def _throttled(spark, sf):
    wait = F.when(u("event_id") % 4 == 1, F.lit("pronto")).when(u("event_id") % 2 == 0, F.floor("value").cast("string")).otherwise(F.lit(""))
    return _fetches(spark, sf).select("host", "unix_ts", F.when(u("event_type") == "error", F.lit(429)).otherwise(F.lit(200)).alias("status"), wait.alias("retry_after"))


@query("stream_backoff", """
SELECT 'h' || (user_id % 20) AS host, max(floor(epoch_us(ts) / 1000000) + CASE WHEN event_id % 2 = 0 THEN floor(value) ELSE 1.5 END)::double AS backoff_until, count(*) AS throttles FROM events WHERE event_type = 'error' GROUP BY 1""")
def stream_backoff(spark, sf):
    return _kept(spark, _throttled(spark, sf), "backoff", C.totals(["host"], ["throttles"], ["backoff_until"]), S.backoff_until)


D.CTES["throttle_times"] = "SELECT DISTINCT 'h' || (user_id % 20) AS host, floor(epoch_us(ts) / 1000000)::double AS t FROM events WHERE event_type = 'error'"
D.CTES["notice_walk"] = """
SELECT host, min(t) AS t FROM throttle_times GROUP BY host
UNION ALL SELECT host, nt FROM (SELECT w.host, (SELECT min(e.t) FROM throttle_times e WHERE e.host = w.host AND e.t > w.t + 3) AS nt FROM notice_walk w) WHERE nt IS NOT NULL
"""


@query("stream_backoff_notices", "SELECT host, t AS notified_at FROM notice_walk")
def stream_backoff_notices(spark, sf):
    path, progress = _folders(spark, "notices")
    with S.ordered_store(spark):
        S.append_stream(S.backoff_notices(_throttled(spark, sf)), path, progress).awaitTermination()
    return spark.read.schema("host string, notified_at double").parquet(path)


@query("stream_frontier", """
SELECT seed_url, pending, saved_at, saved_at + 604800000 <= newest - 3600000 AS expired FROM (
  SELECT 'https://u' || user_id || '.example.com/' AS seed_url, (2 * count(*) - count_if(event_type = 'click'))::bigint AS pending, max(epoch_us(ts) // 1000) AS saved_at FROM events GROUP BY user_id), (SELECT max(epoch_us(ts)) // 1000 AS newest FROM events)""")
def stream_frontier(spark, sf):
    """Pending work per crawl: two addresses found per event, one taken on a click; silent crawls have expired."""
    events = _stream(spark, sf, "events", EVENTS)
    changes = events.select(
        F.concat(F.lit("https://u"), u("user_id").cast("string"), F.lit(".example.com/")).alias("seed_url"), "ts", F.unix_millis("ts").alias("unix_ms"),
        F.lit(2).alias("added"), F.when(u("event_type") == "click", F.lit(1)).otherwise(F.lit(0)).alias("taken"))
    path, progress = _folders(spark, "frontier")
    states = C.ChangeTable(spark, path, C.latest(["seed_url"], "batch_no"))
    with S.ordered_store(spark):
        S.frontier_state(changes).writeStream.outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(
            lambda batch, number: states.put(batch.withColumn("batch_no", F.lit(number)), number)).start().awaitTermination()
    return states.read().select("seed_url", "pending", "saved_at", "expired")


@query("stream_mentions", "SELECT resp_id, brand, position, is_domain_citation FROM mention_rows WHERE resp_id IN (SELECT resp_id FROM responses)")
def stream_mentions(spark, sf):
    """Answers analysed as they arrive: stateless, written once."""
    docs = _stream(spark, sf, "documents", DOCUMENTS)
    answers = docs.select(
        u("doc_id").alias("resp_id"), F.lit("").alias("provider"), F.lit("").alias("intent"),
        F.when(u("doc_id") % 50 == 0, F.lit("")).otherwise(u("text")).alias("text"), F.when(u("doc_id") % 50 == 0, F.lit("HTTP 429")).otherwise(F.lit("")).alias("error"))
    path, progress = _folders(spark, "mentions")
    S.append_stream(B.brand_mentions(B.with_mentions(answers, BRANDS)), path, progress).awaitTermination()
    written = spark.read.schema("resp_id long, brand string, position int, is_domain_citation boolean").parquet(path)
    return written.select("resp_id", "brand", "position", "is_domain_citation")
