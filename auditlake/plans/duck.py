"""SQL side of the checks: named subqueries over the supplied tables, assembled into one statement.

The statements are written for the checking engine and share no code with the Spark operators, except for the
formulas of the derived inputs and fixed regular expressions.
"""

from __future__ import annotations

import re

from auditlake.functions import html as H, text as X, urls as U
from auditlake.operators.advice import ADVICE
from auditlake.operators.robots import AI_BOTS
from auditlake.sources.tables import DERIVED

CTES: dict[str, str] = {}


def compose(sql: str) -> str:
    """Prefixes ``sql`` with the subqueries it names, in dependency order."""
    needed: list[str] = []
    open_names: set[str] = set()

    def visit(text: str) -> None:
        words = set(re.findall(r"(?:FROM|JOIN)\s+([a-z_0-9]+)", text))
        for name in CTES:
            if name in words and name not in needed and name not in open_names:
                open_names.add(name)
                visit(CTES[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + sql


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


for _name, (_inputs, _text) in DERIVED.items():
    _text = _text.replace("{epoch}", "cast(floor(epoch_us(ts) / 1000000) AS bigint)").replace("{epoch_ms}", "epoch_us(ts) // 1000")
    CTES[_name] = _text.format(**{i: i for i in _inputs})

# ---------------------------------------------------------------- expressions

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^({_SCHEME}):', 1))"


def authority(u: str) -> str:
    return f"regexp_extract({u}, '^(?:{_SCHEME}:)?//([^/?#]*)', 1)"


def host(u: str) -> str:
    return f"lower({authority(u)})"


def path(u: str) -> str:
    raw = f"regexp_extract({u}, '^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)', 1)"
    return f"regexp_replace({raw}, ';[^/]*$', '')"


def query_part(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1)"


def strip_fragment(u: str) -> str:
    return f"split_part({u}, '#', 1)"


def bare(h: str) -> str:
    return f"(CASE WHEN lower({h}) LIKE 'www.%' THEN substr({h}, 5) ELSE {h} END)"


def site(u: str) -> str:
    return bare(host(u))


def domain(u: str) -> str:
    h = f"regexp_replace(regexp_replace({host(u)}, '^.*@', ''), ':[0-9]*$', '')"
    two = f"regexp_extract({h}, '([^.]+[.][^.]+)$', 1)"
    three = f"regexp_extract({h}, '([^.]+[.][^.]+[.][^.]+)$', 1)"
    return (
        f"(CASE WHEN {two} = '' OR regexp_matches({h}, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') THEN {h} "
        f"WHEN regexp_matches({two}, '^(co|com|net|org|edu|gov|gob|ac|ne|or)[.][a-z][a-z]$') AND {three} <> '' THEN {three} ELSE {two} END)"
    )


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{H.WS}+|{H.WS}+$', '', 'g')"


def decode(x: str) -> str:
    for name, char in {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "middot": "·", "eacute": "é", "hellip": "…"}.items():
        x = f"replace({x}, '&{name};', {lit(char)})"
    return f"replace({x}, '&amp;', '&')"


def nodes(x: str, glue: str) -> str:
    marked = decode(f"regexp_replace({x}, '<[!?/a-zA-Z][^>]*>', chr(1), 'g')")
    return f"array_to_string([y FOR y IN [{trim('z')} FOR z IN string_split({marked}, chr(1))] IF y <> ''], '{glue}')"


def attr(tag: str, name: str) -> str:
    raw = rf"""regexp_extract({tag}, '(?is)[\s"''/]{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)"""
    return decode(rf"""regexp_replace({raw}, '^["'']|["'']$', '', 'g')""")


def tags(doc: str, name: str) -> str:
    return rf"regexp_extract_all({doc}, '(?is)<{name}(?:[\s/][^>]*)?>', 0)"


def elements(doc: str, name: str) -> str:
    return rf"regexp_extract_all({doc}, '(?is)<{name}(?:\s[^>]*)?>.*?</{name}\s*>', 0)"


def start_tag(e: str) -> str:
    return f"regexp_extract({e}, '(?is)^(<[^>]*>)', 1)"


def resolve(h: str, b: str, keep: bool = False) -> str:
    r = h if keep else strip_fragment(h)
    origin = f"({scheme(b)} || '://' || {authority(b)})"
    bpath = f"regexp_extract({b}, '^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)', 1)"
    rpath = f"regexp_extract({r}, '^([^?#]*)', 1)"
    rest = f"substr({r}, length({rpath}) + 1)"
    joined = f"(CASE WHEN starts_with({r}, '/') THEN {rpath} ELSE regexp_replace(regexp_replace({bpath}, '[^/]*$', '') || '/' || {rpath}, '/+', '/', 'g') END)"
    folded = (
        f"list_reduce(string_split({joined}, '/'), lambda acc, s: CASE WHEN s = '..' THEN acc[1:len(acc) - 1] "
        f"WHEN s = '.' THEN acc ELSE list_append(acc, s) END, []::varchar[])"
    )
    closed = f"(array_to_string({folded}, '/') || CASE WHEN regexp_matches({joined}, '(^|/)[.][.]?$') THEN '/' ELSE '' END)"
    return (
        f"(CASE WHEN regexp_matches({r}, '^{_SCHEME}:') THEN {r} WHEN starts_with({r}, '//') THEN {scheme(b)} || ':' || {r} "
        f"WHEN {r} = '' THEN {b} WHEN starts_with({r}, '?') THEN {origin} || {bpath} || {r} "
        f"ELSE {origin} || '/' || ltrim({closed}, '/') || {rest} END)"
    )


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def labels(value: str, table: dict[str, str]) -> str:
    return f"(CASE {value} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {value} END)"


# ------------------------------------------------------------------- page facts

CTES["docs"] = rf"""
SELECT *, regexp_replace(src, '(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>', chr(1), 'g') AS doc
FROM (SELECT *, CASE WHEN coalesce(status, 0) = 200 AND content_type LIKE '%text/html%' THEN html ELSE '' END AS src FROM fetch_rows)
"""
CTES["visible"] = rf"""
SELECT page_id, {nodes(r"regexp_replace(doc, '(?is)<noscript(?:\s[^>]*)?>.*?</noscript\s*>', chr(1), 'g')", ' ')} AS text FROM docs
"""


def meta(want: str) -> str:
    t = tags("d.doc", "meta")
    hits = f"[m FOR m IN {t} IF lower({attr('m', 'name')}) = '{want}']"
    return f"coalesce({trim(attr(hits + '[1]', 'content'))}, '')"


_LINKS = tags("d.doc", "link")
_CANON = f"[l FOR l IN {_LINKS} IF lower({attr('l', 'rel')}) = 'canonical'][1]"
_IMGS = tags("d.doc", "img")

CTES["page_head"] = f"""
SELECT d.page_id, {meta('description')} AS meta_description, {meta('robots')} AS meta_robots, {meta('keywords')} AS meta_keywords,
  {trim(attr(_CANON, 'href'))} AS canonical_href
FROM docs d
"""
CTES["facts"] = rf"""
SELECT f.*, CASE WHEN html_ok THEN sha256(f.text) ELSE '' END AS content_hash,
  coalesce(f.status = 200, false) AND regexp_matches(f.title || ' ' || f.text, '{H.NOT_FOUND.replace('(?iu)', '(?i)').replace("'", "''")}')
    AND (f.word_count <= 60 OR regexp_matches(f.title, '{H.NOT_FOUND.replace('(?iu)', '(?i)').replace("'", "''")}')) AS is_soft_404,
  coalesce(f.status = 200 AND lower(meta_robots || ' ' || x_robots_tag) NOT LIKE '%noindex%' AND (canonical = '' OR canonical = final_url OR canonical = url), false) AS is_indexable,
  CASE WHEN f.final_url = '' THEN f.url ELSE f.final_url END AS address
FROM (
  SELECT d.page_id, d.url, d.site, d.status, d.final_url, d.content_type, d.server, d.x_robots_tag, d.error, d.depth, d.fetch_ms, d.hop_kind, d.src <> '' AS html_ok,
    {nodes(r"regexp_extract(d.doc, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1)", '')} AS title,
    h.meta_description, h.meta_robots, h.meta_keywords,
    CASE WHEN coalesce(h.canonical_href, '') = '' THEN '' ELSE {resolve('h.canonical_href', 'd.final_url')} END AS canonical,
    [{nodes('e', '')} FOR e IN {elements('d.doc', 'h1')}] AS h1,
    [{nodes('e', '')} FOR e IN {elements('d.doc', 'h2')}] AS h2,
    v.text, len(regexp_extract_all(v.text, '{H.VISIBLE}+')) AS word_count,
    len([i FOR i IN {_IMGS} IF {trim(attr('i', 'alt'))} = '']) AS images_without_alt,
    len([a FOR a IN {elements('d.doc', 'a')} IF {trim(attr(start_tag('a'), 'href'))} = '' OR ({nodes('a', '')} = '' AND NOT regexp_matches(a, '(?i)<img[\s/>]'))]) AS empty_anchors,
    {trim(r"""regexp_extract(d.src, '(?i)<meta[^>]+http-equiv=["'']?refresh["'']?[^>]*content=["'']?\s*[0-9]+\s*;\s*url=([^"''>]+)', 1)""")} AS meta_refresh,
    regexp_matches(d.src, '(?i)window\.location(\.href)?\s*=|window\.location\.replace\s*\(|document\.location\s*=') AS js_redirect,
    CASE WHEN d.status IS NOT NULL THEN '' WHEN d.error LIKE '%NAME_NOT_RESOLVED%' THEN 'dns_not_found' WHEN d.error LIKE '%timed out%' THEN 'timeout'
         WHEN d.error LIKE '%refused%' THEN 'connection_refused' WHEN d.error LIKE '%certificate%' THEN 'ssl_error' ELSE 'connection_error' END AS error_type,
    CASE d.hop_kind WHEN 'single' THEN 1 WHEN 'temporary' THEN 1 WHEN 'long' THEN 3 WHEN 'loop' THEN 3 ELSE 0 END::bigint AS n_hops,
    CASE d.hop_kind WHEN 'temporary' THEN 1 WHEN 'long' THEN 1 ELSE 0 END::bigint AS n_temporary
  FROM docs d JOIN visible v ON v.page_id = d.page_id JOIN page_head h ON h.page_id = d.page_id) f
"""
CTES["image_rows"] = f"""
SELECT page_id, src, min(n) AS n FROM (
  SELECT d.page_id, {resolve('s', 'd.final_url', True)} AS src, n
  FROM (SELECT page_id, final_url, unnest(imgs) AS i, generate_subscripts(imgs, 1) AS n FROM (SELECT d.page_id, d.final_url, {_IMGS} AS imgs FROM docs d)) d,
    LATERAL (SELECT {trim(attr('i', 'src'))} AS s) t
  WHERE s <> '' AND lower(s) NOT LIKE 'data:%') GROUP BY page_id, src
"""
CTES["links"] = rf"""
SELECT page_id, site, source, depth, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS link_pos, target, anchor_text, rel,
  {domain('source')} = {domain('target')} AS is_internal
FROM (
  SELECT page_id, site, final_url AS source, depth, n, {resolve('href', 'final_url')} AS target, anchor_text, rel
  FROM (SELECT page_id, site, final_url, depth, n, {trim(attr(start_tag('a'), 'href'))} AS href, {nodes('a', '')} AS anchor_text, {attr(start_tag('a'), 'rel')} AS rel
        FROM (SELECT page_id, site, final_url, depth, unnest(els) AS a, generate_subscripts(els, 1) AS n
              FROM (SELECT d.*, {elements(r"regexp_replace(d.doc, '(?is)<noscript(?:\s[^>]*)?>.*?</noscript\s*>', chr(1), 'g')", 'a')} AS els FROM docs d)))
  WHERE href <> '' AND NOT regexp_matches(href, '^(javascript:|mailto:|tel:|#)'))
WHERE {scheme('target')} IN ('http', 'https')
"""
# what a crawl that obeys robots files has seen
_NEVER = "page_id IN (SELECT page_id FROM page_verdicts WHERE NOT is_allowed)"
CTES["crawl_rows"] = f"""
SELECT * REPLACE (CASE WHEN {_NEVER} THEN NULL ELSE status END AS status, CASE WHEN {_NEVER} THEN '' ELSE final_url END AS final_url) FROM fetch_rows
"""
CTES["crawl"] = f"""
SELECT * REPLACE (NULL::bigint AS status, '' AS final_url, '' AS content_type, '' AS x_robots_tag, 'Bloqueado por robots.txt' AS error, 0::double AS fetch_ms, 'none' AS hop_kind, '' AS title, '' AS meta_description, '' AS meta_robots,
  '' AS meta_keywords, '' AS canonical, []::varchar[] AS h1, []::varchar[] AS h2, '' AS text, 0 AS word_count, 0 AS images_without_alt, 0 AS empty_anchors, '' AS meta_refresh, false AS js_redirect, '' AS error_type, 0 AS n_hops,
  0 AS n_temporary, '' AS content_hash, false AS is_soft_404, false AS is_indexable, url AS address) FROM facts WHERE {_NEVER}
UNION ALL SELECT * FROM facts WHERE NOT {_NEVER}
"""
CTES["crawl_links"] = f"SELECT * FROM links WHERE NOT {_NEVER}"
CTES["admitted"] = "SELECT * FROM crawl_links WHERE is_internal"
CTES["render_rows"] = rf"""
SELECT c.page_id, c.error, c.failed OR c.title = r.title AS title_match, c.failed OR c.description = r.meta_description AS description_match, c.failed OR c.h1 = r.h1 AS h1_match, c.failed OR c.mobile_error <> '' OR c.mobile_match AS mobile_match
FROM (SELECT d.page_id, d.error, d.error <> '' AS failed, d.mobile_error, d.mobile_match, {nodes(r"regexp_extract(d.doc, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1)", '')} AS title, {meta('description')} AS description,
        [{nodes('e', '')} FOR e IN {elements('d.doc', 'h1')}] AS h1
      FROM (SELECT *, regexp_replace(desktop_html, '(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>', chr(1), 'g') AS doc FROM captures) d) c
JOIN crawl r ON r.page_id = c.page_id
"""
CTES["shells"] = """
SELECT c.page_id FROM crawl c JOIN site_signals s ON s.site = c.site AND s.browser_unavailable WHERE c.status = 200 AND c.depth = 0 AND c.page_id NOT IN (SELECT page_id FROM admitted)
"""
CTES["inlink_pairs"] = "SELECT DISTINCT target, source FROM admitted"
_TECH = ", ".join(
    f"CASE WHEN regexp_matches(hay, '(?i){'|'.join(re.escape(m) for m in ms)}') THEN '{n}' END".replace("gtag\\('config'", "gtag\\(''config''")
    for n, ms in H.TECH_MARKERS
)
CTES["tech_rows"] = rf"""
SELECT page_id, CASE WHEN gen = '' OR list_contains(found, gen) THEN found ELSE list_append(found, gen) END AS tech FROM (
  SELECT page_id, [t FOR t IN [{_TECH}] IF t IS NOT NULL] AS found,
    {trim(r"""regexp_extract(src, '(?i)<meta[^>]+name=["'']generator["''][^>]+content=["'']([^"'']+)', 1)""")} AS gen
  FROM (SELECT page_id, src, src || ' server: ' || server || ' ' AS hay FROM docs WHERE src <> ''))
"""

# ------------------------------------------------------------- robots and sitemaps

CTES["robots_marks"] = r"""
SELECT site, line_no - 1 AS line_no, CASE WHEN raw = '' THEN 'blank' ELSE lower(trim(regexp_extract(regexp_replace(raw, '#.*$', ''), '^([^:]*):', 1))) END AS directive,
  trim(regexp_extract(regexp_replace(raw, '#.*$', ''), '^[^:]*:(.*)$', 1)) AS value
FROM (SELECT site, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM robots_docs)
"""
CTES["robots_groups"] = """
SELECT *, sum(CASE WHEN directive = 'user-agent' AND before <> 'user-agent' THEN 1 ELSE 0 END) OVER w AS group_no,
  max(CASE WHEN directive = 'user-agent' THEN line_no END) OVER w AS last_agent, coalesce(max(CASE WHEN directive = 'blank' THEN line_no END) OVER w, -1) AS last_blank
FROM (SELECT *, coalesce(lag(directive) OVER (PARTITION BY site ORDER BY line_no), 'blank') AS before FROM robots_marks
      WHERE directive IN ('blank', 'user-agent', 'allow', 'disallow', 'crawl-delay', 'request-rate'))
WINDOW w AS (PARTITION BY site ORDER BY line_no)
"""
CTES["robots_all"] = """
SELECT a.site, a.group_no, a.value AS agent, r.line_no AS rule_no, r.directive, r.value
FROM robots_groups a JOIN robots_groups r ON r.site = a.site AND r.group_no = a.group_no AND r.directive NOT IN ('user-agent', 'blank') AND r.last_agent > r.last_blank
WHERE a.directive = 'user-agent'
"""
_BOTS = ", ".join(f"({i}, {lit(b)}, {lit(d)})" for i, (b, d) in enumerate(AI_BOTS))
CTES["bots"] = f"SELECT * FROM (VALUES {_BOTS}, (98, 'SiteAuditBot', 'own'), (99, '*', 'any')) t(bot_no, bot, description)"
CTES["bot_groups"] = """
SELECT site, bot_no, arg_min(group_no, (is_default::int, group_no)) AS group_no FROM (
  SELECT r.site, b.bot_no, r.group_no, bool_or(r.agent = '*') AS is_default, bool_or(contains(lower(b.bot), lower(r.agent))) AS named
  FROM robots_all r CROSS JOIN bots b GROUP BY ALL)
WHERE is_default OR named GROUP BY site, bot_no
"""
CTES["bot_rules"] = """
SELECT DISTINCT g.site, g.bot_no, r.rule_no, r.directive = 'allow' OR r.value = '' AS allow, replace(url_encode(url_decode(r.value)), '%2F', '/') AS path
FROM bot_groups g JOIN robots_all r ON r.site = g.site AND r.group_no = g.group_no AND r.directive IN ('allow', 'disallow')
"""
CTES["robots_paths"] = """
SELECT page_id, site, CASE WHEN tail = '' THEN '/' ELSE replace(url_encode(tail), '%2F', '/') END AS tail
FROM (SELECT page_id, site, regexp_replace(regexp_replace(url_decode(url), '^[a-zA-Z]+://[^/?#]*', ''), '[?#]$', '') AS tail FROM fetch_rows)
"""
CTES["page_verdicts"] = """
SELECT p.page_id, coalesce(arg_min(r.allow, r.rule_no), true) AS is_allowed
FROM robots_paths p LEFT JOIN bot_rules r ON r.site = p.site AND r.bot_no = 98 AND starts_with(p.tail, r.path) GROUP BY p.page_id
"""
CTES["site_bot_access"] = """
SELECT s.site, b.bot_no, b.bot, b.description, s.site IN (SELECT site FROM robots_docs) AS robots_found,
  coalesce((SELECT arg_min(r.allow, r.rule_no) FROM bot_rules r WHERE r.site = s.site AND r.bot_no = b.bot_no AND starts_with('/', r.path)), true) AS allowed
FROM site_list s CROSS JOIN bots b WHERE b.bot_no < 90
"""
CTES["sitemap_files"] = """
SELECT site, 'https://' || site || '/sitemap-' || part || '.xml' AS sitemap_url, 200 AS status,
  '<urlset><url><loc>' || string_agg(loc, '</loc></url><url><loc>' ORDER BY page_id) || '</loc></url><url><loc>https://' || site || '/huerfana-a</loc></url><url><loc>https://' || site
  || '/huerfana-b</loc></url><url><loc>https://fuera.example.info/x</loc></url></urlset>' AS xml FROM sitemap_parts GROUP BY site, part
UNION ALL SELECT site, 'https://' || site || '/sitemap_index.xml', 200, '<sitemapindex><sitemap><loc>' || string_agg('https://' || site || '/sitemap-' || part || '.xml', '</loc></sitemap><sitemap><loc>' ORDER BY part)
  || '</loc></sitemap><sitemap><loc>https://' || site || '/sitemap_index.xml</loc></sitemap><sitemap><loc>https://' || site || '/falta.xml</loc></sitemap><sitemap><loc>https://' || site || '/rota.xml</loc></sitemap></sitemapindex>'
  FROM (SELECT DISTINCT site, part FROM sitemap_parts) GROUP BY site
UNION ALL SELECT site, 'https://' || site || '/rota.xml', 200, '<html></html>' FROM (SELECT DISTINCT site FROM sitemap_parts)
UNION ALL SELECT site, 'https://' || site || '/falta.xml', 404, '' FROM (SELECT DISTINCT site FROM sitemap_parts)
UNION ALL SELECT site, 'https://' || site || '/sitemap.xml', 200, '<urlset><url><loc>https://' || site || '/</loc></url></urlset>' FROM (SELECT DISTINCT site FROM sitemap_parts) WHERE length(site) % 5 = 3
"""
CTES["sitemap_entries"] = """
SELECT site, sitemap_url, status, root, loc_pos - 1 AS loc_pos, replace(loc, '&amp;', '&') AS loc FROM (
  SELECT site, sitemap_url, status, regexp_extract(xml, '^<([a-z]+)>', 1) AS root, unnest(regexp_extract_all(xml, '<loc>([^<]*)</loc>', 1)) AS loc,
    generate_subscripts(regexp_extract_all(xml, '<loc>([^<]*)</loc>', 1), 1) AS loc_pos FROM sitemap_files)
"""
CTES["sitemap_starts"] = """
SELECT site, trim(split_part(raw, 'itemap:', 2)) AS sitemap_url FROM (SELECT site, unnest(string_split(text, chr(10))) AS raw FROM robots_docs) WHERE lower(raw) LIKE 'sitemap:%'
UNION SELECT site, 'https://' || site || '/sitemap.xml' FROM site_list WHERE site NOT IN (SELECT site FROM robots_docs WHERE text LIKE '%Sitemap:%')
"""
# the fixture's trees have two levels: the start file, then its children
CTES["sitemap_visits"] = """
SELECT site, sitemap_url, visit_no FROM (
  SELECT site, sitemap_url, row_number() OVER (PARTITION BY site ORDER BY level, pos) AS visit_no FROM (
    SELECT site, sitemap_url, arg_min(level, (level, pos)) AS level, arg_min(pos, (level, pos)) AS pos FROM (
      SELECT site, sitemap_url, 0 AS level, 0 AS pos FROM sitemap_starts
      UNION ALL SELECT e.site, e.loc, 1, e.loc_pos FROM sitemap_starts s JOIN sitemap_entries e ON e.site = s.site AND e.sitemap_url = s.sitemap_url AND e.root = 'sitemapindex' AND e.status = 200)
    GROUP BY site, sitemap_url))
"""
CTES["listed"] = """
SELECT v.site, v.visit_no, v.sitemap_url, e.loc_pos, e.loc FROM sitemap_visits v
JOIN sitemap_entries e ON e.site = v.site AND e.sitemap_url = v.sitemap_url AND e.root = 'urlset' AND e.status = 200
"""
CTES["members"] = "SELECT DISTINCT site, split_part(loc, '#', 1) AS loc FROM listed"
CTES["in_sitemap_rows"] = """
SELECT f.page_id, f.site IN (SELECT site FROM members) AS site_has_sitemap,
  EXISTS (SELECT 1 FROM members m WHERE m.site = f.site AND m.loc = f.url) OR EXISTS (SELECT 1 FROM members m WHERE m.site = f.site AND m.loc = CASE WHEN f.final_url = '' THEN f.url ELSE f.final_url END) AS in_sitemap
FROM crawl_rows f
"""
CTES["orphans"] = f"""
SELECT site, url, arg_min(visit_no, (visit_no, loc_pos)) AS visit_no, arg_min(loc_pos, (visit_no, loc_pos)) AS loc_pos
FROM (SELECT site, visit_no, loc_pos, split_part(loc, '#', 1) AS url FROM listed)
WHERE {site('url')} = site AND url NOT IN (SELECT target FROM admitted) AND url <> 'https://' || site || '/' GROUP BY site, url
"""
CTES["broken_rows"] = """
SELECT i.page_id, list(i.src ORDER BY i.n) AS broken_images FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n) AS k FROM image_rows) i
JOIN assets a ON a.src = i.src WHERE i.page_id NOT IN (SELECT page_id FROM page_verdicts WHERE NOT is_allowed) AND (a.status IS NULL OR a.status >= 400) GROUP BY i.page_id
"""

# ------------------------------------------------------------------- findings

CTES["audited_pages"] = """
SELECT f.*, s.in_sitemap, s.site_has_sitemap, NOT v.is_allowed AS is_blocked, coalesce(b.broken_images, []::varchar[]) AS broken_images, o.url IS NOT NULL AS is_orphan,
  p.url IS NOT NULL AS is_priority_url, r.error AS render_error, r.title_match, r.description_match, r.h1_match, r.mobile_match, f.page_id IN (SELECT page_id FROM shells) AS is_shell, p.url IS NOT NULL OR p2.url IS NOT NULL AS is_priority,
  CASE WHEN f.status = 200 AND f.content_hash <> '' THEN c.n ELSE 1 END AS same_content, CASE WHEN f.status = 200 AND f.title <> '' THEN t.n ELSE 1 END AS same_title,
  CASE WHEN f.status = 200 AND f.meta_description <> '' THEN m.n ELSE 1 END AS same_meta
FROM crawl f JOIN in_sitemap_rows s ON s.page_id = f.page_id JOIN page_verdicts v ON v.page_id = f.page_id LEFT JOIN broken_rows b ON b.page_id = f.page_id
LEFT JOIN orphans o ON o.site = f.site AND o.url = f.url LEFT JOIN priority_list p ON p.url = f.url LEFT JOIN priority_list p2 ON p2.url = f.final_url LEFT JOIN render_rows r ON r.page_id = f.page_id
LEFT JOIN (SELECT site, content_hash, count(*) AS n FROM crawl WHERE status = 200 GROUP BY ALL) c ON c.site = f.site AND c.content_hash = f.content_hash
LEFT JOIN (SELECT site, title, count(*) AS n FROM crawl WHERE status = 200 GROUP BY ALL) t ON t.site = f.site AND t.title = f.title
LEFT JOIN (SELECT site, meta_description, count(*) AS n FROM crawl WHERE status = 200 GROUP BY ALL) m ON m.site = f.site AND m.meta_description = f.meta_description
"""


def _rule(number: int, category: str, severity: str, code: str, when: str, message: str) -> str:
    sev = severity if severity.startswith("CASE") else f"'{severity}'"
    cod = code if code.startswith("CASE") or code == "error_type" else f"'{code}'"
    return (
        f"SELECT page_id, site, url, {number} AS rule_no, '{category}' AS category, {sev} AS severity, {cod} AS code, {message} AS message "
        f"FROM audited_pages WHERE NOT is_blocked AND ({when})"
    )


_OK = "status = 200"
_DIRECTIVES = "lower(meta_robots || ' ' || x_robots_tag)"
_PATH = path("url")
_ERROR_TEXT = "CASE error_type " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in X.ERROR_LABELS.items()) + " END"
_RULES = [
    ("response_codes", "critical", "error_type", "status IS NULL", f"{_ERROR_TEXT} || CASE WHEN error = '' THEN '' ELSE ' (' || error || ')' END || '.'"),
    ("response_codes", "critical", "error_404", "status = 404", "'La página devuelve 404.'"),
    ("response_codes", "critical", "error_4xx", "status BETWEEN 400 AND 499 AND status <> 404", "'La página devuelve un error del cliente (' || status || ').'"),
    ("response_codes", "critical", "error_5xx", "status >= 500", "'La página devuelve un error del servidor (' || status || ').'"),
    ("url_conventions", "warning", "url_uppercase", f"{_PATH} <> lower({_PATH})", "'La URL contiene mayúsculas.'"),
    ("url_conventions", "warning", "url_underscore", f"contains({_PATH}, '_')", "'La URL contiene guion bajo (usar guiones medios).'"),
    ("url_conventions", "warning", "url_multi_slash", f"contains({_PATH}, '//')", "'La URL contiene barras (/) duplicadas.'"),
    ("url_conventions", "info", "url_numeric_or_special", f"regexp_matches({_PATH}, '[0-9]|[^a-zA-Z0-9/._~%:-]')", "'La URL contiene números o caracteres especiales.'"),
    ("links", "warning", "broken_image", "len(broken_images) > 0",
     "len(broken_images) || ' imagen(es) no cargan: ' || array_to_string(broken_images[1:3], ', ') || CASE WHEN len(broken_images) > 3 THEN ' (y ' || (len(broken_images) - 3) || ' más)' ELSE '' END || '.'"),
    ("titles", "critical", "title_missing", f"{_OK} AND title = ''", "'Falta la etiqueta <title>.'"),
    ("titles", "warning", "title_too_short", f"{_OK} AND length(title) BETWEEN 1 AND 14", "'Title muy corto (' || length(title) || ' caracteres).'"),
    ("titles", "warning", "title_too_long", f"{_OK} AND length(title) > 60", "'Title muy largo (' || length(title) || ' caracteres).'"),
    ("meta", "warning", "meta_description_missing", f"{_OK} AND meta_description = ''", "'Falta la meta description.'"),
    ("meta", "info", "meta_description_too_short", f"{_OK} AND length(meta_description) BETWEEN 1 AND 49", "'Meta description muy corta (' || length(meta_description) || ' caracteres).'"),
    ("meta", "info", "meta_description_too_long", f"{_OK} AND length(meta_description) > 160", "'Meta description muy larga (' || length(meta_description) || ' caracteres).'"),
    ("meta", "warning", "h1_missing", f"{_OK} AND len(h1) = 0", "'Falta la etiqueta <h1>.'"),
    ("meta", "info", "h1_multiple", f"{_OK} AND len(h1) > 1", "'Hay ' || len(h1) || ' etiquetas <h1> en la página.'"),
    ("meta", "info", "h2_missing", f"{_OK} AND len(h2) = 0", "'La página no tiene ningún encabezado <h2>.'"),
    ("directives", "critical", "noindex", f"{_OK} AND {_DIRECTIVES} LIKE '%noindex%'", "'La página tiene la directiva noindex.'"),
    ("directives", "info", "nofollow_page", f"{_OK} AND {_DIRECTIVES} LIKE '%nofollow%'", "'La página tiene la directiva nofollow a nivel de página.'"),
    ("canonicals", "CASE WHEN is_priority_url THEN 'critical' ELSE 'warning' END", "canonical_points_elsewhere", f"{_OK} AND canonical <> '' AND canonical <> url AND canonical <> address",
     "'El canonical apunta a otra URL (' || canonical || '), lo que puede impedir la indexación de esta página.'"),
    ("meta", "info", "thin_content", f"{_OK} AND word_count < 150", "'Contenido posiblemente escaso (' || word_count || ' palabras).'"),
    ("meta", "warning", "img_alt_missing", f"{_OK} AND images_without_alt > 0", "images_without_alt || ' imagen(es) sin atributo alt.'"),
    ("links", "warning", "empty_anchors", f"{_OK} AND empty_anchors > 0", "empty_anchors || ' etiqueta(s) <a> vacías (sin href o sin texto/imagen).'"),
    ("response_codes", "critical", "soft_404", "is_soft_404", "'La página devuelve 200 pero su contenido indica que es una página de error (soft 404).'"),
    ("redirects", "warning", "temporary_redirect_should_be_permanent", "n_temporary > 0",
     "n_temporary || ' redirect(s) usan código temporal (302/303/307) para lo que parece ser un movimiento permanente; considerar 301.'"),
    ("redirects", "warning", "redirect_chain_too_long", "n_hops > 2", "'Cadena de redirects de ' || n_hops || ' saltos; debería resolverse en un solo salto.'"),
    ("redirects", "critical", "redirect_loop", "hop_kind = 'loop'", "'Se detectó un bucle de redirects (la misma URL aparece más de una vez en la cadena).'"),
    ("redirects", "warning", "meta_refresh_redirect", "(n_hops > 0 OR status = 200) AND meta_refresh <> ''", "'La página usa un redirect por meta-refresh hacia ' || meta_refresh || ' en vez de un 301 HTTP.'"),
    ("redirects", "warning", "js_redirect", "(n_hops > 0 OR status = 200) AND js_redirect", "'La página parece redirigir mediante JavaScript en vez de un 301 HTTP.'"),
    ("rendering", "warning", "render_failed", "render_error <> ''", "'No se pudo renderizar la página: ' || render_error"),
    ("rendering", "warning", "render_title_mismatch", "render_error = '' AND NOT title_match", "'El title en el HTML crudo no coincide con el title renderizado (JS lo modifica).'"),
    ("rendering", "warning", "render_description_mismatch", "render_error = '' AND NOT description_match", "'La meta description en el HTML crudo no coincide con la renderizada.'"),
    ("rendering", "warning", "render_h1_mismatch", "render_error = '' AND NOT h1_match", "'El H1 en el HTML crudo no coincide con el renderizado.'"),
    ("rendering", "warning", "mobile_desktop_mismatch", "render_error = '' AND NOT mobile_match", "'El contenido visible difiere significativamente entre mobile y desktop.'"),
    ("rendering", "critical", "spa_render_unavailable", "is_shell",
     "'El sitio necesita JavaScript para mostrar sus enlaces, pero no se pudo iniciar el navegador de renderizado: Executable doesn''t exist.'"),
    ("directives", "critical", "priority_url_not_indexable", "is_priority AND NOT is_indexable",
     "'Esta URL fue marcada como importante pero no es indexable (noindex, canonical hacia otra URL, o no responde 200).'"),
    ("links", "warning", "orphan_page", "is_orphan", "'Página encontrada en el sitemap pero sin ningún enlace interno hacia ella.'"),
    ("sitemap_robots", "info", "not_in_sitemap", "site_has_sitemap AND is_indexable AND NOT in_sitemap", "'Página indexable que no aparece en el sitemap.xml.'"),
    ("duplicates", "critical", "duplicate_content", "same_content > 1", "'Contenido duplicado con otras ' || (same_content - 1) || ' URL(s).'"),
    ("duplicates", "warning", "duplicate_title", "same_title > 1", "'Title duplicado con otras ' || (same_title - 1) || ' URL(s).'"),
    ("duplicates", "info", "duplicate_meta_description", "same_meta > 1", "'Meta description duplicada con otras ' || (same_meta - 1) || ' URL(s).'"),
]
CTES["found"] = (
    "\nUNION ALL ".join(_rule(i, *r) for i, r in enumerate(_RULES))
    + "\nUNION ALL SELECT page_id, site, url, 0, 'sitemap_robots', 'info', 'blocked_by_robots', 'Esta URL fue descubierta pero no se rastreó por estar bloqueada en robots.txt.' FROM audited_pages WHERE is_blocked"
    + "\nUNION ALL SELECT page_id, site, url, 1, 'links', 'warning', 'orphan_page', 'Página encontrada en el sitemap pero sin ningún enlace interno hacia ella.' FROM audited_pages WHERE is_blocked AND is_orphan"
)
CTES["findings"] = "SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rule_no) - 1 AS issue_seq, CASE severity WHEN 'critical' THEN 10 WHEN 'warning' THEN 3 ELSE 1 END AS weight FROM found"
CTES["page_findings"] = """
SELECT a.*, coalesce(i.n, 0) AS n_issues, coalesce(i.penalty, 0) AS penalty, coalesce(i.codes, []::varchar[]) AS codes, coalesce(i.categories, []::varchar[]) AS categories, coalesce(i.worst, 9) AS worst, coalesce(i.display, '') AS display
FROM audited_pages a LEFT JOIN (
  SELECT page_id, count(*) AS n, sum(weight)::bigint AS penalty, list(code ORDER BY issue_seq) AS codes, list(DISTINCT category) AS categories,
    min(CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) AS worst, string_agg('[' || severity || '] ' || code, '; ' ORDER BY issue_seq) AS display FROM findings GROUP BY page_id) i ON i.page_id = a.page_id
"""
CTES["opps"] = """
SELECT site, code, category, severity, affected_pages, score, row_number() OVER (PARTITION BY site ORDER BY score DESC, fp, fs) AS rank FROM (
  SELECT site, code, arg_min(category, (page_id, issue_seq)) AS category, arg_min(severity, (page_id, issue_seq)) AS severity, count(DISTINCT page_id) AS affected_pages,
    arg_min(weight, (page_id, issue_seq)) * count(DISTINCT page_id) AS score, min(page_id) AS fp, arg_min(issue_seq, (page_id, issue_seq)) AS fs FROM findings GROUP BY site, code)
"""
CTES["breakdown"] = """
SELECT *, row_number() OVER (PARTITION BY site ORDER BY total DESC, list_position(['response_codes', 'titles', 'meta', 'canonicals', 'directives', 'links', 'sitemap_robots', 'security', 'redirects', 'duplicates', 'url_conventions', 'rendering', 'tech'], category)) AS rank
FROM (SELECT site, category, count_if(severity = 'critical')::bigint AS critical, count_if(severity = 'warning')::bigint AS warning, count_if(severity = 'info')::bigint AS info, count(*) AS total FROM findings GROUP BY ALL)
"""
CTES["budget"] = """
SELECT site, count(*) AS total_pages, count_if(is_blocked)::bigint AS blocked_by_robots, count(*) FILTER (WHERE NOT is_blocked AND (status IS NULL OR status >= 400)) AS error_pages,
  count(*) FILTER (WHERE NOT is_blocked AND status < 400) AS ok_pages, count_if(list_contains(codes, 'duplicate_content'))::bigint AS duplicate_pages, count_if(is_orphan)::bigint AS orphan_pages
FROM page_findings GROUP BY site
"""
_ADVICE = ", ".join(f"({lit(c)}, {lit(t)}, {lit(w)}, {lit(s[0])}, {lit(chr(10).join(s))})" for c, t, w, s in ADVICE)
CTES["advice"] = f"SELECT * FROM (VALUES {_ADVICE}) t(code, title, why, fix_step, fix_plan)"
