"""Crawl-history queries over snapshots derived from the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import aggregates as A, history as H, rules
from auditlake.operators.advice import with_advice
from auditlake.plans import duck as D, inputs as I
from auditlake.plans.registry import query
from auditlake.sources.tables import table

u = F.col


def _codes(spark, sf):
    return table(spark, sf, "snapshots").withColumn("crawl_ts", u("crawl_day"))


def _pages(spark, sf):
    return I.stage(H.snapshot_pages(_codes(spark, sf)), "snapshots")


D.CTES["snap"] = "SELECT site, crawl_day AS ts, url, list(code ORDER BY code) AS codes FROM snapshots GROUP BY ALL"
D.CTES["crawl_list"] = """
SELECT site, ts, lag(ts) OVER (PARTITION BY site ORDER BY ts) AS prev, lead(ts) OVER (PARTITION BY site ORDER BY ts) AS nxt, n FROM (SELECT site, ts, count(*) AS n FROM snap GROUP BY ALL)
"""
D.CTES["pairs"] = """
SELECT coalesce(c.site, p.site) AS site, coalesce(c.prev, p.ts) AS previous_ts, coalesce(c.ts, p.nxt) AS crawl_ts, coalesce(c.url, p.url) AS url,
  list_sort([x FOR x IN coalesce(c.codes, []::varchar[]) IF NOT list_contains(coalesce(p.codes, []::varchar[]), x)]) AS added, list_sort([x FOR x IN coalesce(p.codes, []::varchar[]) IF NOT list_contains(coalesce(c.codes, []::varchar[]), x)]) AS resolved,
  p.url IS NULL AS page_added, c.url IS NULL AS page_removed
FROM (SELECT s.*, k.prev FROM snap s JOIN crawl_list k ON k.site = s.site AND k.ts = s.ts AND k.prev IS NOT NULL) c
FULL JOIN (SELECT s.*, k.nxt FROM snap s JOIN crawl_list k ON k.site = s.site AND k.ts = s.ts AND k.nxt IS NOT NULL) p ON p.site = c.site AND p.ts = c.prev AND p.url = c.url
"""


@query("previous_snapshot", "SELECT q.site, q.before_ts, max(c.ts) AS previous_ts FROM (SELECT DISTINCT user_id % 20 AS site, cast(floor((unix_ts - 1704067200) / 86400) AS bigint) + event_id % 3 AS before_ts FROM event_log) q LEFT JOIN crawl_list c ON c.site = q.site AND c.ts < q.before_ts GROUP BY ALL")
def previous_snapshot(spark, sf):
    """As-of lookup for every requested moment."""
    requests = table(spark, sf, "event_log").select(
        (u("user_id") % 20).alias("site"), (F.floor((u("unix_ts") - 1704067200) / 86400) + u("event_id") % 3).alias("before_ts")).distinct()
    return H.previous_snapshot(requests, _codes(spark, sf), width=8)


@query("crawl_diff", "SELECT site, previous_ts, crawl_ts, url, array_to_string(added, ',') AS new_codes, array_to_string(resolved, ',') AS resolved_codes FROM pairs WHERE len(added) > 0 OR len(resolved) > 0")
def crawl_diff(spark, sf):
    diffs = H.consecutive_diffs(_pages(spark, sf)).where((F.size("new_codes") > 0) | (F.size("resolved_codes") > 0))
    return diffs.select("site", "previous_ts", "crawl_ts", "url", F.array_join("new_codes", ",").alias("new_codes"), F.array_join("resolved_codes", ",").alias("resolved_codes"))


@query("page_churn", "SELECT site, crawl_ts, url, CASE WHEN page_added THEN 'new' ELSE 'removed' END AS change FROM pairs WHERE page_added OR page_removed")
def page_churn(spark, sf):
    diffs = H.consecutive_diffs(_pages(spark, sf)).where("page_added OR page_removed")
    return diffs.select("site", "crawl_ts", "url", F.when(u("page_added"), F.lit("new")).otherwise(F.lit("removed")).alias("change"))


@query("diff_summary", """
SELECT *, new_issue_count = 0 AND resolved_issue_count = 0 AND new_pages = 0 AND removed_pages = 0 AS is_empty FROM (
  SELECT site, previous_ts, crawl_ts, sum(len(added))::bigint AS new_issue_count, sum(len(resolved))::bigint AS resolved_issue_count, count_if(page_added)::bigint AS new_pages, count_if(page_removed)::bigint AS removed_pages FROM pairs GROUP BY ALL)""")
def diff_summary(spark, sf):
    return H.diff_summary(H.consecutive_diffs(_pages(spark, sf)))


D.CTES["ends"] = "SELECT site, min(ts) AS older, max(ts) AS newer FROM snap GROUP BY site"


@query("diff_pair", """
SELECT coalesce(a.site, b.site) AS site, coalesce(a.url, b.url) AS url, len([x FOR x IN coalesce(b.codes, []::varchar[]) IF NOT list_contains(coalesce(a.codes, []::varchar[]), x)])::bigint AS n_new,
  len([x FOR x IN coalesce(a.codes, []::varchar[]) IF NOT list_contains(coalesce(b.codes, []::varchar[]), x)])::bigint AS n_resolved, a.url IS NULL AS page_added, b.url IS NULL AS page_removed
FROM (SELECT s.* FROM snap s JOIN ends e ON e.site = s.site AND e.older = s.ts) a FULL JOIN (SELECT s.* FROM snap s JOIN ends e ON e.site = s.site AND e.newer = s.ts) b ON a.site = b.site AND a.url = b.url""")
def diff_pair(spark, sf):
    """Two chosen snapshots per site, the older one first: here the newest against the oldest."""
    pages = _pages(spark, sf)
    ends = pages.groupBy("site").agg(F.min("crawl_ts").alias("older"), F.max("crawl_ts").alias("newer"))
    # chosen snapshots are picked by (site, ts): one short row per site
    old = pages.join(ends.select("site", u("older").alias("crawl_ts")), ["site", "crawl_ts"])
    new = pages.join(ends.select("site", u("newer").alias("crawl_ts")), ["site", "crawl_ts"])
    return H.diff(old, new, ["site", "url"]).select("site", "url", F.size("new_codes").alias("n_new"), F.size("resolved_codes").alias("n_resolved"), "page_added", "page_removed")


def _catalog(spark, sf):
    """Crawls with their page counts; every third day only kept codes, not full pages."""
    return _codes(spark, sf).groupBy("site", "crawl_ts").agg(F.count_distinct("url").alias("page_count")).withColumn("has_full", u("crawl_ts") % 3 != 0)


D.CTES["latest_full"] = "SELECT site, max(ts) AS ts FROM crawl_list WHERE ts % 3 <> 0 GROUP BY site"


@query("latest_snapshots", "SELECT l.site, l.ts AS crawl_ts, c.n AS page_count FROM latest_full l JOIN crawl_list c ON c.site = l.site AND c.ts = l.ts")
def latest_snapshots(spark, sf):
    return H.latest_full(_catalog(spark, sf))


_CODE_CATEGORY = {"thin_content": "meta", "h1_missing": "meta", "error_404": "response_codes", "title_missing": "titles", "duplicate_title": "duplicates"}
_CODE_SEVERITY = {"thin_content": "info", "h1_missing": "warning", "error_404": "critical", "title_missing": "critical", "duplicate_title": "warning"}


def _case(column: str, mapping: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {D.lit(str(k))} THEN {v if isinstance(v, int) else D.lit(v)}" for k, v in mapping.items()) + " END"


PER_SITE = 6  # fixed value: findings of a site in the feed


@query("priority_feed", f"""
SELECT site, code, severity, affected_pages, title, fix_step FROM (
  SELECT o.*, a.title, a.fix_step, row_number() OVER (PARTITION BY site ORDER BY w * affected_pages DESC, first_user, o.code) AS rank FROM (
    SELECT s.site, s.code, {_case('s.code', _CODE_SEVERITY)} AS severity, CASE {_case('s.code', _CODE_SEVERITY)} WHEN 'critical' THEN 10 WHEN 'warning' THEN 3 ELSE 1 END AS w, count(DISTINCT s.url) AS affected_pages, min(cast(substr(s.url, 3) AS bigint)) AS first_user
    FROM snapshots s JOIN latest_full l ON l.site = s.site AND l.ts = s.crawl_day GROUP BY ALL) o JOIN advice a ON a.code = o.code)
WHERE rank <= 6""")
def priority_feed(spark, sf):
    """What matters most across sites: the top findings of each site's newest full crawl, then one order for all."""
    latest = H.latest_full(_catalog(spark, sf)).select("site", "crawl_ts")
    pages = _codes(spark, sf).join(latest, ["site", "crawl_ts"])
    issues = pages.select(
        "site", "code", "url", F.regexp_extract("url", "([0-9]+)", 1).cast("long").alias("page_id"),
        rules.lookup(u("code"), _CODE_CATEGORY).alias("category"), rules.lookup(u("code"), _CODE_SEVERITY).alias("severity"))
    # codes of a page come sorted in a snapshot
    position = F.array_position(F.array(*[F.lit(c) for c in sorted(_CODE_CATEGORY)]), u("code"))
    states = issues.withColumn("issue_seq", position).groupBy("site", "code", "category", "severity").agg(
        F.count("*").alias("findings"), F.count("*").alias("pages"), F.min(F.struct("page_id", "issue_seq")).alias("first"))
    top = A.opportunities(states).where(F.col("rank") <= PER_SITE)
    feed = with_advice(top.select("site", "code", "severity", "affected_pages"))
    ordered = feed.orderBy(rules.order(u("severity")), F.desc("affected_pages"), "site", "code")
    return ordered.select("site", "code", "severity", "affected_pages", "title", "fix_step")
