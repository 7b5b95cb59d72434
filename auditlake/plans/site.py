"""Audit queries: findings, aggregates, rankings, robots and sitemaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import html as H, text as X
from auditlake.functions.binding import unpack
from auditlake.operators import aggregates as A, broken_assets, duplicates, facts as page_facts, keywords as K, links as L, render, robots, rules, site_rules, sitemaps
from auditlake.operators.advice import advice_table, with_advice
from auditlake.operators.grid import SortedGrid
from auditlake.plans import duck as D, inputs as I
from auditlake.plans.registry import query
from auditlake.sources import sinks
from auditlake.sources.tables import AS_OF, AS_OF_EPOCH, sitemap_docs, table

u = F.col


# ------------------------------------------------------------------- findings


@query("page_issues", "SELECT page_id, url, issue_seq, category, severity, code, message FROM findings")
def page_issues(spark, sf):
    return rules.issue_rows(I.audited(spark, sf)).drop("site")


@query("issue_export", 'SELECT url AS "URL", category AS "Category", severity AS "Severity", code AS "Code", message AS "Message" FROM findings')
def issue_export(spark, sf):
    return sinks.issue_export(I.audited(spark, sf))


@query("page_export", """
SELECT p.url AS "URL", p.status AS "Status Code", p.is_indexable AS "Indexable", p.title AS "Title", length(p.title) AS "Title Length", p.meta_description AS "Meta Description",
  length(p.meta_description) AS "Meta Description Length", array_to_string(p.h1, ' | ') AS "H1", p.canonical AS "Canonical", p.meta_robots AS "Meta Robots", p.word_count AS "Word Count", p.depth AS "Depth",
  p.n_hops AS "Redirect Chain Length", p.final_url AS "Final URL", coalesce(array_to_string(t.tech, ', '), '') AS "Tech", p.is_soft_404 AS "Soft 404",
  greatest(p.fetch_ms - 0.05, 0)::double AS "Fetch Time (ms)", p.n_issues AS "Issue Count", p.display AS "Issues" FROM page_findings p LEFT JOIN tech_rows t ON t.page_id = p.page_id AND NOT p.is_blocked""")
def page_export(spark, sf):
    return sinks.page_export(I.audited(spark, sf))


@query("snapshot_rows", "SELECT site, url, status, array_to_string(list_sort(list_distinct(codes)), ',') AS codes FROM page_findings")
def snapshot_rows(spark, sf):
    """A crawl saved as a version and read back."""
    crawls = I.versioned(spark, "crawls")
    sinks.save_crawl(I.audited(spark, sf), crawls, "every site", AS_OF_EPOCH)
    return crawls.read().select("site", "url", "status", F.array_join("codes", ",").alias("codes"))


@query("audit_grid", """
SELECT CASE WHEN p.is_orphan THEN '🕸 ' ELSE '' END || p.url AS url, coalesce(p.status::string, '—') AS status, CASE WHEN p.is_indexable THEN 'Sí' ELSE 'No' END AS indexable, p.title, length(p.title) AS title_len,
  p.meta_description, length(p.meta_description) AS meta_len, array_to_string(p.h1, ' | ') AS h1, p.word_count, p.canonical, p.depth, CASE WHEN p.in_sitemap THEN 'Sí' ELSE 'No' END AS in_sitemap,
  coalesce(array_to_string(k.keywords, ', '), '') AS keywords, coalesce(array_to_string(t.tech, ', '), '') AS tech, p.n_issues AS issue_count, CASE p.worst WHEN 0 THEN 'Crítico' WHEN 1 THEN 'Advertencia' WHEN 2 THEN 'Info' ELSE 'Sin issues' END AS max_severity
FROM page_findings p LEFT JOIN tech_rows t ON t.page_id = p.page_id AND NOT p.is_blocked LEFT JOIN page_top k ON k.page_id = p.page_id AND NOT p.is_blocked""")
def audit_grid(spark, sf):
    """The page grid, worst severity first."""
    words = K.top_keywords(I.facts(spark, sf, keep_text=True)).select("page_id", u("keywords").alias("words"))
    found = F.when(~u("is_blocked"), u("words"))
    pages = I.stage(I.audited(spark, sf).join(words, "page_id", "left").withColumn("keywords", F.coalesce(found, F.array().cast("array<string>"))), "grid")  # sorting samples its input first
    yes = lambda c: F.when(c, F.lit("Sí")).otherwise(F.lit("No"))
    return pages.orderBy(A.worst_severity(), "page_id").select(
        F.concat(F.when(u("is_orphan"), F.lit("🕸 ")).otherwise(F.lit("")), "url").alias("url"),
        F.coalesce(u("status").cast("string"), F.lit("—")).alias("status"), yes(page_facts.is_indexable()).alias("indexable"), "title", F.length("title").alias("title_len"),
        "meta_description", F.length("meta_description").alias("meta_len"), F.array_join("h1", " | ").alias("h1"), "word_count", "canonical", "depth", yes(u("in_sitemap")).alias("in_sitemap"),
        F.array_join("keywords", ", ").alias("keywords"), F.array_join("tech", ", ").alias("tech"), F.size("issues").alias("issue_count"), A.max_severity().alias("max_severity"))


_ORDERS = [("title", False), ("word_count", True)]


@query("audit_grid_sorted", """
SELECT 'title' AS sorted_by, row_number() OVER (ORDER BY title ASC NULLS FIRST, page_id) AS position, page_id, title, word_count FROM page_findings
UNION ALL SELECT 'word_count', row_number() OVER (ORDER BY word_count DESC NULLS LAST, page_id), page_id, title, word_count FROM page_findings""")
def audit_grid_sorted(spark, sf):
    """The grid sorted by two of its columns: every page's place in each order, from stored ranges."""
    rows = I.audited(spark, sf).select("page_id", "title", "word_count")
    placed = []
    for column, descending in _ORDERS:
        grid = SortedGrid(spark, I.folder(spark, "grid"), column, "page_id", descending)
        grid.save(rows)
        placed.append(grid.positions().select(F.lit(column).alias("sorted_by"), "position", "page_id", "title", "word_count"))
    return placed[0].unionByName(placed[1])


@query("grid_filters", """
SELECT page_id, n_issues > 0 AS any_issue, is_orphan AS orphan, list_contains(categories, 'duplicates') AS duplicate, list_contains(categories, 'meta') AS meta, list_contains(categories, 'links') AS links FROM page_findings""")
def grid_filters(spark, sf):
    return I.audited(spark, sf).select(
        "page_id", (F.size("issues") > 0).alias("any_issue"), u("is_orphan").alias("orphan"), A.in_category("duplicates").alias("duplicate"),
        A.in_category("meta").alias("meta"), A.in_category("links").alias("links"))


@query("error_pages", """
SELECT page_id, site, url, status, CASE WHEN error <> '' THEN error WHEN status IS NULL THEN 'Sin respuesta' ELSE 'HTTP ' || status END AS label FROM page_findings
WHERE NOT is_blocked AND (status IS NULL OR status >= 400) ORDER BY status NULLS LAST, page_id""")
def error_pages(spark, sf):
    return A.error_pages(I.audited(spark, sf))


@query("page_detail", """
SELECT page_id, 'issue' AS relation, severity AS k, code AS v FROM findings UNION ALL SELECT page_id, 'outlink', target, anchor_text FROM crawl_links
UNION ALL SELECT f.page_id, 'inlink', e.source, '' FROM crawl f JOIN inlink_pairs e ON e.target = f.address
UNION ALL SELECT page_id, 'header', unnest(['content-type', 'server']), unnest([content_type, server]) FROM crawl WHERE status IS NOT NULL UNION ALL SELECT page_id, 'header', 'x-robots-tag', x_robots_tag FROM crawl WHERE status IS NOT NULL AND x_robots_tag <> ''
UNION ALL SELECT page_id, 'hop', url, '301' FROM crawl WHERE hop_kind IN ('single', 'long') UNION ALL SELECT page_id, 'hop', url, '302' FROM crawl WHERE hop_kind = 'temporary'
UNION ALL SELECT page_id, 'hop', url || '~1', '308' FROM crawl WHERE hop_kind = 'long' UNION ALL SELECT page_id, 'hop', url || '~2', '307' FROM crawl WHERE hop_kind = 'long'
UNION ALL SELECT page_id, 'hop', unnest([url, url || '~1', url]), '301' FROM crawl WHERE hop_kind = 'loop'""")
def page_detail(spark, sf):
    """Everything shown for one page, as (relation, key, value) rows for all pages."""
    pages, audited = I.crawled(spark, sf), I.audited(spark, sf)
    row = lambda df, kind, k, v: df.select("page_id", F.lit(kind).alias("relation"), k.alias("k"), v.alias("v"))
    edges = page_facts.page_links(pages)
    found = rules.issue_rows(audited)
    hops = unpack(pages.select("page_id", "redirect_chain"), "redirect_chain", "h")
    heads = unpack(pages.select("page_id", F.map_entries("headers").alias("e")), "e", "h")
    inlinks = L.page_inlinks(pages, I.crawl(spark, sf).edges)
    return (
        row(found, "issue", u("severity"), u("code"))
        .unionByName(row(edges, "outlink", u("target"), u("anchor_text")))
        .unionByName(row(inlinks, "inlink", u("source"), F.lit("")))
        .unionByName(row(heads, "header", u("h.key"), u("h.value")))
        .unionByName(row(hops, "hop", u("h.url"), u("h.status").cast("string")))
    )


@query("priority_flag", "SELECT page_id, is_priority_url, is_priority FROM audited_pages")
def priority_flag(spark, sf):
    pages = I.crawl_rows(spark, sf).select("page_id", "url", "final_url")
    flagged = pages.select("page_id").join(I.priority_flags(pages, table(spark, sf, "priority_list")), "page_id", "left")
    no = F.lit(False)
    return flagged.select("page_id", F.coalesce("is_priority_url", no).alias("is_priority_url"), F.coalesce("is_priority", no).alias("is_priority"))


@query("broken_images", "SELECT page_id, array_to_string(broken_images, ' ') AS broken_images FROM broken_rows")
def broken_images(spark, sf):
    found = broken_assets.broken_images(I.crawled(spark, sf), table(spark, sf, "assets"))
    return found.select("page_id", F.array_join("broken_images", " ").alias("broken_images"))


# ----------------------------------------------------------------- duplicates


def _groups(name: str, key: str):
    @query(name, f"""
SELECT f.page_id, f.site, f.{key} AS shared, g.group_size FROM crawl f JOIN (
  SELECT site, {key}, count(*) AS group_size FROM crawl WHERE status = 200 AND {key} <> '' GROUP BY ALL HAVING count(*) > 1) g ON g.site = f.site AND g.{key} = f.{key} WHERE f.status = 200""")
    def run(spark, sf):
        pages = I.crawled(spark, sf)
        return duplicates.duplicate_groups(pages, key).select("page_id", "site", u(key).alias("shared"), "group_size")


@query("duplicate_content", """
SELECT d.doc_id AS page_id, d.source AS site, sha256(d.text) AS shared, g.group_size FROM documents d JOIN (
  SELECT source, sha256(text) AS h, count(*) AS group_size FROM documents GROUP BY ALL HAVING count(*) > 1) g ON g.source = d.source AND g.h = sha256(d.text)""")
def duplicate_content(spark, sf):
    """Copies among the documents, which hold whole-text duplicates (the pages differ in their links)."""
    docs = table(spark, sf, "documents").select(
        u("doc_id").alias("page_id"), u("source").alias("site"), u("doc_id").cast("string").alias("url"), F.lit(200).alias("status"), H.content_hash(u("text")).alias("content_hash"))
    return duplicates.duplicate_groups(I.stage(docs, "hashes"), "content_hash").select("page_id", "site", u("content_hash").alias("shared"), "group_size")


_groups("duplicate_titles", "title")
_groups("duplicate_meta", "meta_description")


@query("duplicate_issues", "SELECT page_id, same_content - 1 AS other_content, same_title - 1 AS other_title, same_meta - 1 AS other_meta FROM audited_pages")
def duplicate_issues(spark, sf):
    pages = I.crawled(spark, sf)
    counted = duplicates.with_duplicate_counts(pages)
    return counted.select("page_id", *[(u(f"same_{k}") - 1).alias(f"other_{k}") for k in ("content", "title", "meta")])


# ----------------------------------------------------------------- aggregates


@query("health_score", """
SELECT site, crawled, CASE WHEN crawled = 0 THEN 100 ELSE greatest(0, least(100, round_even(100.0::double - tenths * 6.0::double / (crawled * 10.0::double), 0))) END::bigint AS score FROM (
  SELECT site, count(status) AS crawled, coalesce(sum(CASE WHEN status IS NOT NULL THEN penalty * CASE WHEN is_priority THEN 16 ELSE 10 END END), 0)::bigint AS tenths FROM page_findings GROUP BY site)""")
def health_score(spark, sf):
    return A.health_score(I.page_states(spark, sf))


@query("score_bands", """
SELECT CASE WHEN score < 50 THEN 'critical' WHEN score < 80 THEN 'warning' ELSE 'good' END AS band, count(*) AS sites FROM (
  SELECT site, CASE WHEN count(status) = 0 THEN 100 ELSE greatest(0, least(100, round_even(100.0::double - coalesce(sum(CASE WHEN status IS NOT NULL THEN penalty * CASE WHEN is_priority THEN 16 ELSE 10 END END), 0)::bigint * 6.0::double / (count(status) * 10.0::double), 0))) END AS score
  FROM page_findings GROUP BY site) GROUP BY band""")
def score_bands(spark, sf):
    return A.health_score(I.page_states(spark, sf)).groupBy(X.score_band(u("score")).alias("band")).agg(F.count("*").alias("sites"))


@query("category_breakdown", "SELECT site, category, critical, warning, info, total, rank FROM breakdown")
def category_breakdown(spark, sf):
    return A.category_breakdown(I.code_states(spark, sf))


@query("audit_totals", """
SELECT site, count(*) AS total_pages, count(*) FILTER (WHERE NOT is_blocked AND status < 400) AS ok_pages, round_even(100.0::double * count(*) FILTER (WHERE NOT is_blocked AND status < 400) / count(*), 0)::bigint AS ok_percent, (sum(fetch_ms) / 1000)::double AS fetch_seconds FROM page_findings GROUP BY site""")
def audit_totals(spark, sf):
    """Share of pages that answered well, and the time spent fetching."""
    return A.ok_share(I.page_states(spark, sf))


@query("category_share", "SELECT site, category, total, round_even(100.0::double * total / sum(total) OVER (PARTITION BY site), 0)::bigint AS percent FROM breakdown")
def category_share(spark, sf):
    return A.category_share(I.code_states(spark, sf))


@query("crawl_budget", "SELECT site, total_pages, blocked_by_robots, error_pages, ok_pages, duplicate_pages, orphan_pages FROM budget")
def crawl_budget(spark, sf):
    return A.crawl_budget(I.page_states(spark, sf))


@query("opportunities", "SELECT site, code, category, severity, affected_pages, score::bigint AS score, rank FROM opps")
def opportunities(spark, sf):
    return A.opportunities(I.code_states(spark, sf))


@query("top_opportunities", "SELECT site, code, affected_pages, rank FROM opps WHERE rank <= 8")
def top_opportunities(spark, sf):
    return A.opportunities(I.code_states(spark, sf)).where("rank <= 8").select("site", "code", "affected_pages", "rank")


@query("opportunity_advice", f"""
SELECT o.site, o.code, o.affected_pages, o.rank, coalesce(a.title, '') AS title, coalesce(a.why, '') AS why, coalesce(a.fix_step, 'Revisa este hallazgo y decide si aplica una corrección.') AS fix_step, coalesce(a.fix_plan, 'Revisa este hallazgo y decide si aplica una corrección.') AS fix_plan FROM opps o LEFT JOIN advice a ON a.code = o.code""")
def opportunity_advice(spark, sf):
    opps = A.opportunities(I.code_states(spark, sf)).select("site", "code", "affected_pages", "rank")
    return with_advice(opps)


_SIDE = ", ".join(f"count_if(category = '{c}' AND severity = '{s}')::bigint AS {c}_{s}" for c in rules.CATEGORIES for s in rules.SEVERITY_WEIGHT)


@query("sidebar_counts", f"""
SELECT p.*, {", ".join(f"coalesce(i.{c}_{s}, 0) AS {c}_{s}" for c in rules.CATEGORIES for s in rules.SEVERITY_WEIGHT)} FROM (
  SELECT site, count(*) AS all_pages, count_if(n_issues > 0)::bigint AS with_issues, count_if(is_orphan)::bigint AS orphans, count_if(list_contains(categories, 'duplicates'))::bigint AS duplicates FROM page_findings GROUP BY site) p
LEFT JOIN (SELECT site, {_SIDE} FROM findings GROUP BY site) i ON i.site = p.site""")
def sidebar_counts(spark, sf):
    return A.sidebar_counts(I.audited(spark, sf))


@query("tech_distribution", """
SELECT 'tech' AS kind, t AS value, count(*) AS pages FROM (SELECT unnest(tech) AS t FROM tech_rows WHERE page_id IN (SELECT page_id FROM page_verdicts WHERE is_allowed)) GROUP BY t UNION ALL SELECT 'status', coalesce(status::string, ''), count(*) FROM crawl GROUP BY status
UNION ALL SELECT 'depth', depth::string, count(*) FROM crawl GROUP BY depth""")
def tech_distribution(spark, sf):
    pages = I.crawled(spark, sf)
    values = F.concat(
        F.transform("tech", lambda t: F.struct(F.lit("tech").alias("kind"), t.alias("value"))),
        F.array(F.struct(F.lit("status").alias("kind"), F.coalesce(u("status").cast("string"), F.lit("")).alias("value")),
                F.struct(F.lit("depth").alias("kind"), u("depth").cast("string").alias("value"))))
    return unpack(pages.select(values.alias("vs")), "vs", "v").groupBy("v.kind", "v.value").agg(F.count("*").alias("pages"))


@query("top_offenders", "SELECT * FROM (SELECT page_id, site, url, penalty, row_number() OVER (PARTITION BY site ORDER BY penalty DESC, page_id) AS rank FROM page_findings WHERE n_issues > 0) WHERE rank <= 5")
def top_offenders(spark, sf):
    return A.top_offenders(I.audited(spark, sf))


@query("truncated_lists", """
SELECT site, url, row_no, group_rows, greatest(group_rows - 4, 0) AS overflow FROM (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY page_id) AS row_no, count(*) OVER (PARTITION BY site) AS group_rows FROM fetch_rows) WHERE row_no <= 4""")
def truncated_lists(spark, sf):
    pages = table(spark, sf, "fetch_rows").select("page_id", "site", "url")
    return A.truncated(pages, ["site"], ["page_id"], 4).select("site", "url", "row_no", "group_rows", "overflow")


@query("area_report", """
SELECT site, category, code, severity, row_no, url, affected, greatest(affected - 40, 0) AS overflow FROM (
  SELECT *, row_number() OVER (PARTITION BY site, category, code ORDER BY page_id, issue_seq) AS row_no, count(*) OVER (PARTITION BY site, category, code) AS affected FROM findings) WHERE row_no <= 40""")
def area_report(spark, sf):
    """Reports written by area and read back."""
    reports = I.versioned(spark, "area-reports")
    sinks.write_area_reports(sinks.area_report(rules.issue_rows(I.audited(spark, sf))), reports)
    return reports.read()


@query("next_steps", """
SELECT site, row_number() OVER (PARTITION BY site ORDER BY n) AS step_no, step FROM (
  SELECT b.site, 1 AS n, 'Priorizar: ' || lower(a.title) || ' (' || o.affected_pages || ' páginas afectadas).' AS step FROM budget b JOIN opps o ON o.site = b.site AND o.severity = 'critical' JOIN advice a ON a.code = o.code
    WHERE o.rank = (SELECT min(rank) FROM opps x WHERE x.site = b.site AND x.severity = 'critical')
  UNION ALL SELECT site, 2, 'La categoría con más hallazgos es "' || array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(category, '_')], ' ') || '" — enfocar el primer sprint de correcciones ahí.' FROM breakdown WHERE rank = 1
  UNION ALL SELECT site, 3, 'Resolver las ' || error_pages || ' páginas con error para recuperar presupuesto de rastreo.' FROM budget WHERE error_pages > 0
  UNION ALL SELECT site, 4, 'Reevaluar el sitio después de aplicar las correcciones para medir el impacto.' FROM budget UNION ALL SELECT site, 5, 'Programar auditorías periódicas para detectar regresiones a tiempo.' FROM budget)""")
def next_steps(spark, sf):
    codes, pages = I.code_states(spark, sf), I.page_states(spark, sf)
    return A.next_steps(A.opportunities(codes), A.category_breakdown(codes), A.crawl_budget(pages), advice_table(spark))


# ---------------------------------------------------------- robots and sitemaps


@query("robots_rules", "SELECT site, group_no::bigint AS group_no, agent, rule_no, directive = 'allow' OR value = '' AS allow, value AS path FROM robots_all WHERE directive IN ('allow', 'disallow')")
def robots_rules(spark, sf):
    return robots.path_rules(robots.robots_rules(table(spark, sf, "robots_docs")))


@query("robots_crawl_delay", """
SELECT g.site, max(r.value::double) AS crawl_delay FROM bot_groups g JOIN robots_all r ON r.site = g.site AND r.group_no = g.group_no AND r.directive = 'crawl-delay' AND regexp_full_match(r.value, '[0-9]+') WHERE g.bot_no = 98 GROUP BY g.site""")
def robots_crawl_delay(spark, sf):
    return robots.crawl_delays(table(spark, sf, "robots_docs"), I.AGENT)


@query("robots_allowed", "SELECT page_id, is_allowed FROM page_verdicts")
def robots_allowed(spark, sf):
    pages = table(spark, sf, "fetch_rows").select("page_id", "site", "url")
    return robots.robots_allowed(pages, table(spark, sf, "robots_docs"), I.AGENT).select("page_id", "is_allowed")


@query("bot_access", "SELECT site, bot, description, robots_found, allowed FROM site_bot_access")
def bot_access(spark, sf):
    return robots.bot_access(table(spark, sf, "site_list"), table(spark, sf, "robots_docs")).drop("bot_no")


@query("sitemap_locs", "SELECT e.site, e.sitemap_url, e.root = 'sitemapindex' AS is_index, e.loc_pos, e.loc FROM sitemap_entries e WHERE e.status = 200")
def sitemap_locs(spark, sf):
    parsed = sitemaps.parse_sitemaps(sitemap_docs(spark, sf).where("status = 200"))
    return unpack(parsed, "locs", "loc", "loc_pos").select("site", "sitemap_url", "is_index", "loc_pos", "loc")


@query("sitemap_expand", "SELECT site, visit_no, sitemap_url, loc_pos, loc FROM listed")
def sitemap_expand(spark, sf):
    return I.listed(spark, sf)


@query("sitemap_membership", "SELECT page_id, in_sitemap, site_has_sitemap FROM in_sitemap_rows")
def sitemap_membership(spark, sf):
    pages = I.crawl_rows(spark, sf).select("page_id", "site", "url", "final_url")
    listed = I.stage(I.listed(spark, sf), "listed")
    inside = sitemaps.members(pages, listed).withColumn("in_sitemap", F.lit(True))
    both = I.site_signals(spark, sf, pages, listed).join(inside, "page_id", "left")
    no = F.lit(False)
    return both.select("page_id", F.coalesce("in_sitemap", no).alias("in_sitemap"), F.coalesce("site_has_sitemap", no).alias("site_has_sitemap"))


@query("sitemap_broken", """
SELECT l.site, l.loc, coalesce(f.status, 200)::bigint AS status FROM listed l LEFT JOIN (
  SELECT site, CASE WHEN final_url = '' THEN url ELSE final_url END AS loc, arg_max(status, page_id) AS status FROM crawl_rows WHERE status IS NOT NULL GROUP BY ALL) f ON f.site = l.site AND f.loc = l.loc WHERE coalesce(f.status, 200) >= 400""")
def sitemap_broken(spark, sf):
    pages = I.crawl_rows(spark, sf).select("page_id", "site", "url", "final_url", "status")
    return sitemaps.listed_status(pages, I.listed(spark, sf)).where("status >= 400").select("site", "loc", "status")


@query("missing_from_sitemap", """
SELECT DISTINCT site, CASE WHEN final_url = '' THEN url ELSE final_url END AS loc FROM crawl_rows WHERE status IS NOT NULL EXCEPT SELECT site, loc FROM listed""")
def missing_from_sitemap(spark, sf):
    pages = I.crawl_rows(spark, sf).select("page_id", "site", "url", "final_url", "status")
    return sitemaps.missing_from_sitemap(pages, I.listed(spark, sf))


# --------------------------------------------------------------- site findings


_ADDR = "CASE WHEN final_url = '' THEN url ELSE final_url END"
D.CTES["consistency"] = f"""
SELECT site, count(*) AS addresses, count(DISTINCT {D.host('u')} LIKE 'www.%') > 1 AS mixed_www, count(DISTINCT {D.scheme('u')}) > 1 AS mixed_scheme,
  count_if({D.path('u')} NOT IN ('', '/') AND {D.path('u')} LIKE '%/')::bigint AS with_slash, count_if({D.path('u')} NOT IN ('', '/') AND {D.path('u')} NOT LIKE '%/')::bigint AS without_slash
FROM (SELECT site, {_ADDR} AS u FROM crawl_rows WHERE status IS NOT NULL) GROUP BY site
"""


@query("url_consistency", "SELECT site, addresses, mixed_www, mixed_scheme, with_slash, without_slash, with_slash > 0 AND without_slash > 0 AS mixed_trailing_slash FROM consistency")
def url_consistency(spark, sf):
    return A.url_consistency(I.crawl_rows(spark, sf))


_DAYS = "CASE WHEN valid THEN floor((epoch(try_strptime(regexp_replace(replace(not_after, ' GMT', ''), ' +', ' ', 'g'), '%b %d %H:%M:%S %Y')) - 1706745600) / 86400) END"
D.CTES["site_facts"] = f"""
SELECT s.site, r.text IS NOT NULL AS robots_found, coalesce((SELECT arg_min(allow, rule_no) FROM bot_rules b WHERE b.site = s.site AND b.bot_no = 99 AND (b.path = '*' OR starts_with('/', b.path))), true) AS start_allowed,
  r.text LIKE '%Sitemap:%' AS declared, (SELECT count(*) FROM listed l WHERE l.site = s.site) AS n_listed, (SELECT count(*) FROM listed l WHERE l.site = s.site AND l.loc LIKE '%fuera.example.info%') AS off_domain,
  (SELECT count(*) FROM listed l JOIN (SELECT site, {_ADDR} AS loc, arg_max(status, page_id) AS status FROM crawl_rows WHERE status IS NOT NULL GROUP BY ALL) f ON f.site = l.site AND f.loc = l.loc WHERE l.site = s.site AND f.status >= 400) AS n_broken,
  (SELECT count(*) FROM (SELECT DISTINCT site, {_ADDR} AS loc FROM crawl_rows WHERE status IS NOT NULL EXCEPT SELECT site, loc FROM listed) m WHERE m.site = s.site) AS n_missing,
  c.mixed_www, c.mixed_scheme, c.with_slash > 0 AND c.without_slash > 0 AS mixed_slash, k.valid, k.error AS tls_error, {_DAYS} AS days_left, p.final_url AS probe_url, p.hop_statuses, p.error AS probe_error, g.browser_fallback, g.browser_unavailable
FROM site_list s LEFT JOIN robots_docs r ON r.site = s.site LEFT JOIN consistency c ON c.site = s.site JOIN certificates k ON k.site = s.site JOIN http_probes p ON p.site = s.site JOIN site_signals g ON g.site = s.site
"""
_SITE_RULES = [
    ("sitemap_robots", "info", "robots_missing", "NOT robots_found", "'No se encontró robots.txt (se asume que todo está permitido).'"),
    ("sitemap_robots", "critical", "robots_blocks_everything", "robots_found AND NOT start_allowed", "'robots.txt bloquea el rastreo de la URL semilla para todos los user-agents.'"),
    ("sitemap_robots", "warning", "robots_no_sitemap_directive", "robots_found AND NOT declared", "'robots.txt no declara ninguna directiva Sitemap:.'"),
    ("rendering", "warning", "render_browser_unavailable", "browser_unavailable", "'No se pudo iniciar el navegador para renderizado JS, se continuó sin él.'"),
    ("security", "critical", "mixed_www", "mixed_www", "'El sitio responde tanto en versión www como sin www sin redirigir a una sola.'"),
    ("security", "critical", "mixed_scheme", "mixed_scheme", "'El sitio responde tanto en HTTP como en HTTPS sin redirigir a una sola versión.'"),
    ("url_conventions", "warning", "mixed_trailing_slash", "mixed_slash", "'El sitio mezcla URLs con y sin barra final sin una convención consistente.'"),
    ("sitemap_robots", "warning", "sitemap_empty", "n_listed = 0", "'El sitemap no contiene URLs.'"),
    ("sitemap_robots", "warning", "sitemap_off_domain_urls", "n_listed > 0 AND off_domain > 0", "'El sitemap incluye ' || off_domain || ' URL(s) de otro dominio.'"),
    ("sitemap_robots", "critical", "sitemap_broken_urls", "n_listed > 0 AND n_broken > 0", "'El sitemap incluye ' || n_broken || ' URL(s) que devuelven error 4xx/5xx.'"),
    ("sitemap_robots", "info", "sitemap_missing_crawled_urls", "n_listed > 0 AND n_missing > 0", "n_missing || ' URL(s) rastreadas no aparecen en el sitemap.'"),
    ("security", "critical", "http_not_redirected_to_https", "probe_url LIKE 'http://%'", "'La versión HTTP no redirige a HTTPS.'"),
    ("security", "warning", "https_no_redirect_detected", "probe_url LIKE 'https://%' AND hop_statuses = ''", "'No se detectó un redirect explícito de HTTP a HTTPS (verificar configuración del servidor).'"),
    ("security", "warning", "http_to_https_not_permanent", "probe_url LIKE 'https://%' AND hop_statuses LIKE '%302%'", "'El redirect de HTTP a HTTPS no usa un código permanente (301/308).'"),
    ("security", "warning", "http_check_failed", "probe_url IS NULL AND probe_error <> ''", "'No se pudo verificar el redirect HTTP→HTTPS: ' || probe_error"),
    ("security", "critical", "tls_invalid", "NOT valid AND NOT browser_fallback", "'Certificado HTTPS inválido o inalcanzable: ' || tls_error"),
    ("security", "critical", "tls_expired", "days_left < 0", "'El certificado HTTPS ya expiró.'"),
    ("security", "warning", "tls_expiring_soon", "days_left BETWEEN 0 AND 13", "'El certificado HTTPS expira en ' || days_left::bigint || ' día(s).'"),
    ("security", "info", "tls_browser_fallback", "browser_fallback",
     "'El servidor exige una versión de TLS que el cliente HTTP directo no soporta (p. ej. sitios configurados solo-TLS 1.3); las páginas se descargaron a través del navegador Chromium integrado.'"),
]
D.CTES["site_found"] = "\nUNION ALL ".join(
    f"SELECT site, {i} AS n, '{c}' AS category, '{s}' AS severity, '{k}' AS code, {m} AS message FROM site_facts WHERE {w}" for i, (c, s, k, w, m) in enumerate(_SITE_RULES))


def _site_issues(spark, sf, listed):
    pages = I.crawl_rows(spark, sf)
    inputs = site_rules.site_inputs(
        table(spark, sf, "site_list"), pages, table(spark, sf, "robots_docs"), listed, table(spark, sf, "certificates"),
        table(spark, sf, "http_probes"), table(spark, sf, "site_signals"), F.lit(AS_OF).cast("timestamp"))
    return site_rules.site_issues(inputs)


@query("site_issues", "SELECT site, row_number() OVER (PARTITION BY site ORDER BY n) - 1 AS issue_seq, category, severity, code, message FROM site_found")
def site_issues(spark, sf):
    return _site_issues(spark, sf, I.stage(I.listed(spark, sf), "listed"))


@query("site_infrastructure", """
SELECT s.site, s.robots_found, s.robots_found AND s.start_allowed OR NOT s.robots_found AS robots_allows_crawling, NOT s.robots_found OR coalesce(s.declared, false) AS robots_declares_sitemap, s.n_listed > 0 AS sitemap_found, s.n_listed AS sitemap_url_count,
  coalesce((SELECT string_agg(code, ',' ORDER BY code) FROM site_found f WHERE f.site = s.site AND f.code NOT IN ('robots_missing', 'robots_blocks_everything', 'robots_no_sitemap_directive', 'sitemap_empty')), '') AS other_findings FROM site_facts s""")
def site_infrastructure(spark, sf):
    listed = I.stage(I.listed(spark, sf), "listed")
    return site_rules.site_infrastructure(table(spark, sf, "site_list"), _site_issues(spark, sf, listed), listed)


D.CTES["typed_pages"] = "SELECT f.page_id, f.site, f.status, f.meta_description <> '' AS described, f.page_id IN (SELECT page_id FROM ld_items WHERE item LIKE '%@type%') AS structured FROM crawl f"


@query("ai_readiness", """
SELECT c.site, b.robots_found, b.blocked_bots, c.pages_ok, c.structured_pages, c.described_pages, round_even(least(100.0::double, 40.0::double * (1.0::double - b.blocked_bots / 11.0::double) + CASE WHEN g.llms_txt THEN 20.0::double ELSE 0.0::double END
  + 20.0::double * CASE WHEN c.pages_ok > 0 THEN c.structured_pages::double / c.pages_ok ELSE 0.0::double END + 10.0::double * CASE WHEN c.pages_ok > 0 THEN c.described_pages::double / c.pages_ok ELSE 0.0::double END + CASE WHEN g.encyclopedia THEN 10.0::double ELSE 0.0::double END), 0)::bigint AS readiness
FROM (SELECT site, count(*) FILTER (WHERE status = 200) AS pages_ok, count(*) FILTER (WHERE status = 200 AND structured) AS structured_pages, count(*) FILTER (WHERE status = 200 AND described) AS described_pages FROM typed_pages GROUP BY site) c
JOIN (SELECT site, count_if(NOT allowed)::bigint AS blocked_bots, bool_or(robots_found) AS robots_found FROM site_bot_access GROUP BY site) b ON b.site = c.site JOIN site_signals g ON g.site = c.site""")
def ai_readiness(spark, sf):
    access = robots.bot_access(table(spark, sf, "site_list"), table(spark, sf, "robots_docs"))
    return site_rules.ai_readiness(I.crawled(spark, sf), access, table(spark, sf, "site_signals"))


@query("structured_types", r"""
SELECT site, string_agg(t, ',' ORDER BY t) AS types FROM (SELECT DISTINCT f.site, unnest(regexp_extract_all(replace(i.item::string, '["FAQPage","HowTo"]', '"FAQPage","@type":"HowTo"'), '"@type":"([A-Za-z]+)"', 1)) AS t
  FROM crawl f JOIN ld_items i ON i.page_id = f.page_id WHERE f.status = 200) GROUP BY site""")
def structured_types(spark, sf):
    """Distinct types reduce map-side; a site uses a vocabulary-sized set of them."""
    pages = I.crawled(spark, sf).where("status = 200").select("site", "json_ld_types")
    kinds = unpack(pages, "json_ld_types", "t").select("site", "t").distinct()
    return kinds.groupBy("site").agg(F.array_join(F.sort_array(F.collect_set("t")), ",").alias("types"))


# ---------------------------------------------------------------------- render


@query("render_compare", "SELECT page_id, title_match, description_match, h1_match, mobile_match FROM render_rows")
def render_compare(spark, sf):
    return render.compare_captures(I.crawled(spark, sf), I.captures(spark, sf)).select("page_id", "render.title_match", "render.description_match", "render.h1_match", "render.mobile_match")


@query("link_union_last", """
SELECT page_id, target, min(source_no * 1000000 + link_pos) // 1000000 AS source_no, min(source_no * 1000000 + link_pos) % 1000000 AS link_pos, arg_max(anchor_text, source_no * 1000000 + link_pos) AS anchor_text FROM (
  SELECT page_id, target, 0::bigint AS source_no, link_pos, anchor_text FROM links UNION ALL SELECT page_id, target, 1, link_pos, anchor_text || ' js' FROM links) GROUP BY page_id, target""")
def link_union_last(spark, sf):
    """Each target once, at its first place, worded as in the rendering."""
    raw = I.stage(page_facts.page_links(I.facts(spark, sf)).select("page_id", "link_pos", "target", "anchor_text", "rel"), "links")
    seen = raw.withColumn("anchor_text", F.concat("anchor_text", F.lit(" js")))
    return render.link_union(raw, seen, last_wins=True).select("page_id", "target", "source_no", "link_pos", "anchor_text")


@query("link_union", """
SELECT page_id, target, source_no, link_pos FROM (SELECT *, row_number() OVER (PARTITION BY page_id, target ORDER BY source_no, link_pos) AS n FROM (
  SELECT page_id, target, 0::bigint AS source_no, link_pos FROM links UNION ALL SELECT page_id, target || CASE WHEN link_pos % 4 = 0 THEN '-js' ELSE '' END, 1, link_pos FROM links)) WHERE source_no = 0 OR n = 1""")
def link_union(spark, sf):
    """Raw links plus those of a rendering in which some targets are new."""
    raw = I.stage(page_facts.page_links(I.facts(spark, sf)).select("page_id", "link_pos", "target", "anchor_text", "rel"), "links")
    seen = raw.withColumn("target", F.when(u("link_pos") % 4 == 0, F.concat("target", F.lit("-js"))).otherwise(u("target")))
    return render.link_union(raw, seen).select("page_id", "target", "source_no", "link_pos")
