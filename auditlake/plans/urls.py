"""URL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import urls as U
from auditlake.functions.binding import unpack
from auditlake.operators import facts as page_facts, links
from auditlake.plans import duck as D, inputs as I
from auditlake.plans.registry import query
from auditlake.sources.tables import table

u = F.col


@query("url_normalize", f"""
SELECT page_id, n, href, {D.resolve('href', 'final_url')} AS resolved FROM (
  SELECT page_id, final_url, generate_subscripts(els, 1) - 1 AS n, {D.attr(D.start_tag('unnest(els)'), 'href')} AS href
  FROM (SELECT page_id, final_url, {D.elements('doc', 'a')} AS els FROM docs))""")
def url_normalize(spark, sf):
    """Every link of every page, resolved against its page."""
    pages = page_facts.parsed_anchors(I.tables.fetches(spark, sf))
    return unpack(pages, "hrefs", "href", "n").select(
        "page_id", "n", "href", U.resolve_against(u("href"), u("base")).alias("resolved"))


@query("url_parts", f"""
SELECT page_id, {D.scheme('url')} AS scheme, {D.host('url')} AS host, {D.path('url')} AS path, {D.scheme('url')} = 'https' AS is_https,
  {D.host('url')} LIKE 'www.%' AS is_www, {D.site('url')} AS bare_host, {D.path('url')} NOT IN ('', '/') AND {D.path('url')} LIKE '%/' AS trailing_slash FROM pages""")
def url_parts(spark, sf):
    url = u("url")
    return table(spark, sf, "pages").select(
        "page_id", U.scheme(url).alias("scheme"), U.host(url).alias("host"), U.path(url).alias("path"), U.is_https(url).alias("is_https"),
        U.is_www(url).alias("is_www"), U.strip_www(U.host(url)).alias("bare_host"), U.has_trailing_slash(url).alias("trailing_slash"))


@query("site_key", f"""
SELECT page_id, {D.domain('url')} AS registrable, {D.site('url')} AS site, regexp_replace({D.domain('url')}, '[^a-z0-9.-]', '_', 'g') AS domain_slug,
  replace({D.host('url')}, ':', '_') AS host_slug, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS name_slug FROM pages""")
def site_key(spark, sf):
    url = u("url")
    return table(spark, sf, "pages").select(
        "page_id", U.registrable_domain(url).alias("registrable"), U.site_key(url).alias("site"), U.partition_slug(url).alias("domain_slug"),
        U.host_slug(url).alias("host_slug"), U.name_slug(url).alias("name_slug"))


D.CTES["suffix_rules"] = """
SELECT * FROM (VALUES ('co.uk', 2), ('com.br', 2), ('k12.ca.us', 3), ('ca.us', 2)) t(suffix, size)
"""
D.CTES["suffix_hosts"] = """
SELECT page_id, h, string_split(h, '.') AS l, len(string_split(h, '.')) AS n FROM (SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), ':[0-9]*$', ''), '[.]$', '') AS h FROM suffix_urls)
"""


@query("registrable_domains", """
SELECT page_id, array_to_string(l[greatest(1, n - size):n], '.') AS registrable FROM (
  SELECT page_id, any_value(l) AS l, any_value(n) AS n, CASE WHEN any_value(h) LIKE '%.city.kawasaki.jp' THEN 2 WHEN any_value(h) LIKE '%.www.ck' THEN 1 WHEN any_value(h) LIKE '%.%.kawasaki.jp' THEN 3 WHEN any_value(h) LIKE '%.kawasaki.jp' THEN 3
    WHEN any_value(h) LIKE '%.ck' THEN 2 ELSE coalesce(max(size), 1) END AS size
  FROM suffix_hosts LEFT JOIN suffix_rules ON h = suffix OR ends_with(h, '.' || suffix) GROUP BY page_id)""")
def registrable_domains(spark, sf):
    """Plain, wildcard and exception rules, longest match first."""
    return table(spark, sf, "suffix_urls").select("page_id", U.registrable_domain(u("url")).alias("registrable"))


@query("link_scope", f"""
SELECT page_id, link_pos, target, is_internal, {D.site('source')} = {D.site('target')} AS same_host FROM links""")
def link_scope(spark, sf):
    edges = page_facts.page_links(I.facts(spark, sf))
    return edges.select("page_id", "link_pos", "target", "is_internal", U.is_same_site(u("source"), u("target")).alias("same_host"))


@query("url_variants", r"""
SELECT page_id, kind, variant FROM (
  SELECT page_id, 'http' AS kind, regexp_replace(url, '^[a-z]+:', 'http:') AS variant FROM pages UNION ALL
  SELECT page_id, 'https', regexp_replace(url, '^[a-z]+:', 'https:') FROM pages UNION ALL
  SELECT page_id, 'www', regexp_replace(url, '^([a-z]+://)(?:www[.])?', '\1www.') FROM pages UNION ALL
  SELECT page_id, 'bare', regexp_replace(url, '^([a-z]+://)www[.]', '\1') FROM pages UNION ALL
  SELECT page_id, 'slash', lead || CASE WHEN path LIKE '%/' AND path <> '/' THEN left(path, length(path) - 1) WHEN path = '' THEN '/' ELSE path || '/' END || substr(url, length(lead || path) + 1)
  FROM (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS lead, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages))""")
def url_variants(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(U.variants(u("url"))).alias("v")).select("page_id", "v.kind", "v.variant")


@query("url_variant_groups", f"""
SELECT variant_key, count(*) AS addresses, count(DISTINCT {D.scheme('url')}) AS schemes, count(DISTINCT {D.host('url')}) AS hosts,
  count_if({D.path('url')} LIKE '%/')::bigint AS with_slash FROM (
  SELECT DISTINCT target AS url, {D.site('target')} || regexp_replace({D.path('target')}, '/$', '') || CASE WHEN {D.query_part('target')} = '' THEN '' ELSE '?' || {D.query_part('target')} END AS variant_key
  FROM (SELECT target FROM links UNION ALL SELECT CASE WHEN final_url = '' THEN url ELSE final_url END FROM fetch_rows UNION ALL SELECT url FROM fetch_rows))
GROUP BY variant_key HAVING count(*) > 1""")
def url_variant_groups(spark, sf):
    """Addresses seen on pages or in links that differ only by scheme, www or slash."""
    pages = I.facts(spark, sf)
    address = F.when(u("final_url") == "", u("url")).otherwise(u("final_url"))
    seen = page_facts.page_links(pages).select(u("target").alias("url"))
    fetched = table(spark, sf, "fetch_rows")
    seen = seen.unionByName(fetched.select(address.alias("url"))).unionByName(fetched.select("url")).distinct()
    keyed = seen.withColumn("variant_key", U.variant_key(u("url")))
    return keyed.groupBy("variant_key").agg(
        F.count("*").alias("addresses"), F.count_distinct(U.scheme(u("url"))).alias("schemes"), F.count_distinct(U.host(u("url"))).alias("hosts"),
        F.count_if(U.path(u("url")).endswith("/")).alias("with_slash")).where("addresses > 1")


@query("url_query_params", f"""
SELECT page_id, link_pos, target, len(list_distinct([split_part(kv, '=', 1) FOR kv IN string_split({D.query_part('target')}, '&') IF contains(kv, '=') AND substr(kv, instr(kv, '=') + 1) <> '']))::bigint AS n_params FROM links""")
def url_query_params(spark, sf):
    edges = page_facts.page_links(I.facts(spark, sf))
    return edges.select("page_id", "link_pos", "target", U.query_param_count(u("target")).alias("n_params"))


@query("url_conventions", f"""
SELECT page_id, link_pos, {D.path('target')} <> lower({D.path('target')}) AS url_uppercase, {D.path('target')} LIKE '%~_%' ESCAPE '~' AS url_underscore,
  {D.path('target')} LIKE '%//%' AS url_multi_slash, len([s FOR s IN string_split({D.path('target')}, '/') IF regexp_matches(s, '[0-9]|[^a-zA-Z0-9/._~%:-]')]) > 0 AS url_numeric_or_special FROM links""")
def url_conventions(spark, sf):
    edges = page_facts.page_links(I.facts(spark, sf))
    return edges.select("page_id", "link_pos", *[c.alias(n) for n, c in U.convention_flags(u("target")).items()])


@query("frontier_admission", f"""
SELECT page_id, link_pos, target, length(target) <= 60 AND NOT regexp_matches(target, '/[A-Z]') AND len(list_distinct([split_part(kv, '=', 1) FOR kv IN string_split({D.query_part('target')}, '&') IF kv LIKE '%=_%'])) <= 1
  AND starts_with({D.path('target')}, CASE WHEN {D.path('source')} = '' THEN '/' ELSE regexp_replace({D.path('source')}, '/[^/]*$', '') || '/' END) AND lower(rel) NOT LIKE '%nofollow%' AS admitted FROM links""")
def frontier_admission(spark, sf):
    """Link limits: length, an exclude pattern, query parameters, the start folder (here the page's) and nofollow."""
    edges = page_facts.page_links(I.facts(spark, sf))
    ok = links.url_allowed(u("target"), 60, ("/[A-Z]",), 1, U.start_folder(u("source"))) & links.link_allowed(u("rel"), False)
    return edges.select("page_id", "link_pos", "target", ok.alias("admitted"))


@query("discovered_links", f"""
SELECT page_id, link_pos, target FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY link_pos) AS n FROM links WHERE is_internal AND {D.site('source')} = {D.site('target')} AND lower(rel) NOT LIKE '%nofollow%')
WHERE n <= 3""")
def discovered_links(spark, sf):
    edges = page_facts.page_links(I.facts(spark, sf))
    return links.discovered_links(edges, follow_nofollow=False, max_links_per_page=3).select("page_id", "link_pos", "target")
