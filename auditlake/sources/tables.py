"""Inputs of the registered queries.

The supplied tables hold page addresses and HTML only.  Everything else a crawl delivers (status, headers,
redirect hops, robots files, sitemaps, snapshots, answers ...) is derived from them by closed formulas, so each
input grows with its table.  The formulas are plain SQL that reads the same in Spark and in the checking engine.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2024-02-01 00:00:00"
AS_OF_EPOCH = 1706745600

DERIVED: dict[str, tuple[tuple[str, ...], str]] = {}

# One row per fetched address.  The neighbours that a page links to are found on narrow rows and joined once; a hub has
# at most some two hundred pages, whatever the size.
DERIVED["fetch_rows"] = (
    ("pages",),
    """
SELECT page_id, url, site, status, final_url, content_type, server, x_robots_tag, error, depth, fetch_ms, hop_kind,
  CASE WHEN page_id % 25 = 24 THEN '<html><head><title>En obras</title></head><body><article><h1>En obras</h1><p>Vuelve pronto.</p></article></body></html>' ELSE
  replace(replace(replace(html, '<title>', '<title>'
    || CASE WHEN page_id % 33 = 4 THEN repeat('Largo ', 12) WHEN page_id % 44 = 6 THEN 'Página no encontrada ' ELSE '' END), '<head>', '<head>'
    || CASE WHEN page_id % 8 = 3 THEN '<META CONTENT=''' || repeat('texto extenso ', 14) || cast(page_id % 9 as string) || ''' NAME=''Description''>'
            WHEN page_id % 4 = 1 THEN '<meta name="description" content="Breve &amp; ' || cast(page_id % 50 as string) || '">'
            WHEN page_id % 4 = 2 THEN '<meta name="description" content="' || repeat('palabra clave ', 6) || cast(page_id % 50 as string) || '">'
            WHEN page_id % 4 = 3 THEN '<meta name="description" content="' || repeat('relato largo ', 15) || cast(page_id % 9 as string) || '">'
            ELSE '' END
    || CASE WHEN page_id % 9 = 0 THEN '<link rel="canonical" href="../canon/' || cast(page_id % 5 as string) || '">'
            WHEN page_id % 9 < 6 THEN '<link href="' || replace(final_url, '&', '&amp;') || '" rel="canonical">' ELSE '' END
    || CASE WHEN page_id % 11 = 0 THEN '<meta name="robots" content="noindex">'
            WHEN page_id % 22 = 1 THEN '<meta name="ROBOTS" content="index, nofollow">' ELSE '' END
    || CASE WHEN page_id % 6 = 0 THEN '<meta name="keywords" content=" seo, prueba ">' ELSE '' END
    || CASE WHEN page_id % 10 = 3 THEN '<link rel="alternate" hreflang="es" href="/es/' || cast(page_id as string) || '"><link rel="alternate" hreflang="en" href="../../en/./x"><link rel="alternate" href="/feed">' ELSE '' END
    || CASE WHEN page_id % 10 = 0 THEN '<meta name="generator" content="WordPress 6.4"><script src="/wp-content/a.js"></script>' ELSE '' END
    || CASE WHEN page_id % 16 = 0 THEN '<script type="application/ld+json">{{"@type":"Article","name":"a"}}</script>'
            WHEN page_id % 16 = 8 THEN '<script type="application/ld+json">{{"@graph":[{{"@type":"WebSite"}},{{"@type":"Person"}}]}}</script>'
            WHEN page_id % 16 = 4 THEN '<script type="application/ld+json">[{{"@type":["FAQPage","HowTo"]}},{{"@type":"Thing"}}]</script>'
            WHEN page_id % 16 = 12 THEN '<script type="application/ld+json">{{"@type":</script>' ELSE '' END
    || CASE WHEN page_id % 37 = 1 THEN '<meta http-equiv="refresh" content="5; url=https://' || site || '/nuevo">' ELSE '' END
    || CASE WHEN page_id % 41 = 2 THEN '<script>window.location.href = "/x";</script>' ELSE '' END),
  '<article>', '<article>'
    || CASE WHEN page_id % 3 <> 0 THEN '<h2>Parte <b>uno</b></h2>' ELSE '' END
    || CASE WHEN page_id % 6 = 1 THEN '<h2 class="s"> Dos </h2>' ELSE '' END
    || CASE WHEN page_id % 15 = 2 THEN '<h1>Segundo</h1>' ELSE '' END
    || CASE WHEN page_id % 43 = 3 THEN '<p>Error 404: page not found</p>' ELSE '' END
    || CASE WHEN page_id % 5 = 0 THEN '<img src="/img/' || cast(page_id % 40 as string) || '.png">'
            WHEN page_id % 5 = 1 THEN '<img src="/img/' || cast(page_id % 40 as string) || '.png" alt="foto"><img src="data:image/png;base64,AAAA" alt=" "><img alt="b" src="/img/20.png"><img src="/img/20.png" alt="c">' ELSE '' END
    || CASE WHEN page_id % 6 = 2 THEN '<a href="">x</a><a href="/vacio"></a><a href="/logo"><img src="/img/1.png" alt="l"></a>' ELSE '' END
    || CASE WHEN next_url IS NOT NULL THEN '<a href="' || replace(next_url, '&', '&amp;') || '">Siguiente <b>hoja</b></a>' ELSE '' END
    || CASE WHEN hub_url IS NOT NULL THEN '<a class="hub" href="' || replace(hub_url, '&', '&amp;') || CASE WHEN page_id % 4 = 2 THEN '" rel="nofollow noopener">Centro</a>' ELSE '">Centro</a>' END ELSE '' END
    || CASE WHEN page_id % 5 = 2 THEN '<a href="../rel/' || cast(page_id % 7 as string) || '?a=1&amp;b=&amp;a=2&amp;c=3#sec">Rel</a><a href="?page=2">q</a><a href="#top">t</a><a href="mailto:a@example.com">m</a><a href="//www.' || site || '/proto">p</a><a href="JavaScript:void(0)">js</a><noscript><a href="/oculto">o</a></noscript>' ELSE '' END
  ) END AS html
FROM (
  SELECT p.page_id, p.html, p.url, p.site, p.status, p.error, p.depth, p.fetch_ms, p.hop_kind,
    CASE WHEN p.status IS NULL THEN '' WHEN p.page_id % 7 = 0 THEN regexp_replace(p.url, '^http:', 'https:')
         WHEN p.page_id % 53 = 9 AND p.url NOT LIKE '%://www.%' THEN replace(p.url, '://', '://www.') ELSE p.url END AS final_url,
    CASE WHEN p.status IS NULL THEN '' WHEN p.page_id % 31 = 5 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
    CASE WHEN p.page_id % 2 = 0 THEN 'nginx' ELSE 'Apache' END AS server,
    CASE WHEN p.page_id % 23 = 0 THEN 'NoFollow' ELSE '' END AS x_robots_tag,
    r.next_url, r.hub_url
  FROM (
    SELECT page_id, html, regexp_replace(url, '#.*$', '')
        || CASE WHEN url LIKE '%?%' THEN '' WHEN page_id % 47 = 11 THEN '/Mayus' WHEN page_id % 47 = 12 THEN '/guion_bajo' WHEN page_id % 47 = 13 THEN '//doble' ELSE '' END AS url,
      regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www[.]', '') AS site,
      cast(CASE WHEN page_id % 29 = 0 THEN NULL WHEN page_id % 13 = 0 THEN 404 WHEN page_id % 17 = 0 THEN 503 WHEN page_id % 19 = 0 THEN 403 ELSE 200 END AS bigint) AS status,
      CASE WHEN page_id % 29 <> 0 THEN ''
           WHEN page_id % 145 = 0 THEN 'net::ERR_NAME_NOT_RESOLVED' WHEN page_id % 145 = 29 THEN 'Read timed out'
           WHEN page_id % 145 = 58 THEN 'Connection refused' WHEN page_id % 145 = 87 THEN 'certificate verify failed' ELSE 'weird' END AS error,
      page_id % 6 AS depth, cast(50 + (page_id * 37) % 400 as double) + 0.25 AS fetch_ms,
      CASE WHEN page_id % 35 = 0 THEN 'loop' WHEN page_id % 21 = 0 THEN 'long' WHEN page_id % 14 = 0 THEN 'temporary' WHEN page_id % 7 = 0 THEN 'single' ELSE 'none' END AS hop_kind
    FROM {pages}) p
  LEFT JOIN (
    SELECT k.page_id, n.url AS next_url, h.url AS hub_url
    FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id - page_id % 200 ELSE page_id - page_id % 10 END AS hub_id FROM {pages}) k
    LEFT JOIN (SELECT page_id - 1 AS before_id, regexp_replace(url, '#.*$', '') AS url FROM {pages}) n ON n.before_id = k.page_id
    LEFT JOIN (SELECT page_id AS at_id, regexp_replace(url, '#.*$', '') AS url FROM {pages}) h ON h.at_id = k.hub_id
  ) r ON r.page_id = p.page_id
) x
""",
)

# Captures of pages that answered: some show another title, description or heading, some fail, some differ on mobile.
DERIVED["captures"] = (
    ("fetch_rows",),
    """
SELECT page_id, replace(replace(replace(html, '<title>', '<title>' || CASE WHEN page_id % 12 = 2 THEN 'Nuevo ' ELSE '' END),
    '<meta name="description" content="', '<meta name="description" content="' || CASE WHEN page_id % 18 = 1 THEN 'JS ' ELSE '' END),
    '<h1>', '<h1>' || CASE WHEN page_id % 16 = 5 THEN 'JS ' ELSE '' END) AS desktop_html,
  page_id % 15 <> 1 AS mobile_match, CASE WHEN page_id % 20 = 6 THEN 'net::ERR_ABORTED' ELSE '' END AS error, CASE WHEN page_id % 30 = 16 THEN 'timeout' ELSE '' END AS mobile_error
FROM {fetch_rows} WHERE status = 200 AND page_id % 2 = page_id % 4 % 3 % 2
""",
)

# Addresses under many kinds of public suffix.
DERIVED["suffix_urls"] = (
    ("pages",),
    """
SELECT page_id, replace(replace(replace(url, '.example.com', suffix), '.example.net', suffix), '.example.org', suffix) AS url FROM (
  SELECT page_id, url, CASE page_id % 13 WHEN 0 THEN '.example.co.uk' WHEN 1 THEN '.tienda.city.kawasaki.jp' WHEN 2 THEN '.tienda.otra.kawasaki.jp' WHEN 3 THEN '.escuela.k12.ca.us' WHEN 4 THEN '.www.ck' WHEN 5 THEN '.uno.dos.ck'
    WHEN 6 THEN '.kawasaki.jp' WHEN 7 THEN '.gov' WHEN 8 THEN '.co.uk' WHEN 9 THEN '.com.br:8080' WHEN 10 THEN '.ck' WHEN 11 THEN '.example.net.' ELSE '.example.com' END AS suffix FROM {pages}) p
""",
)

DERIVED["site_list"] = (
    ("pages",),
    """
SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www[.]', '') AS site FROM {pages}
""",
)

# One robots file per site; sites without a row have none.
DERIVED["robots_docs"] = (
    ("site_list",),
    """
SELECT site, CASE length(site) % 5
  WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow:' || chr(10) || chr(10) || 'Sitemap: https://' || site || '/sitemap_index.xml' || chr(10)
  WHEN 1 THEN '# reglas' || chr(10) || 'User-agent: GPTBot' || chr(10) || 'User-agent: CCBot' || chr(10) || 'Disallow: /' || chr(10) || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /fr/ # nota' || chr(10) || 'Allow: /' || chr(10) || 'Crawl-delay: 2.5' || chr(10) || 'Sitemap: https://' || site || '/sitemap_index.xml'
  WHEN 2 THEN 'User-agent: *' || chr(10) || 'Disallow: /' || chr(10)
  ELSE 'User-agent: SiteAuditBot' || chr(10) || 'Crawl-delay: 3' || chr(10) || 'Allow: /en/' || chr(10) || 'Disallow: /de/' || chr(10) || 'Disallow: /%65s/' || chr(10) || chr(10) || 'Disallow: /perdida' || chr(10) || 'User-agent: *' || chr(10) || 'Crawl-delay: 7' || chr(10) || 'Disallow: /de/' END AS text
FROM {site_list} WHERE length(site) % 5 <> 3
""",
)

# Sitemap files: an index per site and one file per block of a thousand page ids.
DERIVED["sitemap_parts"] = (
    ("fetch_rows",),
    """
SELECT site, cast(floor(page_id / 1000) as bigint) AS part, page_id, replace(url, '&', '&amp;') AS loc FROM {fetch_rows} WHERE url NOT LIKE '%.html' AND url NOT LIKE '%page=2%'
""",
)

DERIVED["responses"] = (
    ("documents",),
    """
SELECT doc_id AS resp_id,
  CASE doc_id % 5 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'gemini' WHEN 3 THEN 'deepseek' ELSE 'perplexity' END AS provider,
  CASE doc_id % 7 % 5 WHEN 0 THEN 'recomendacion_abierta' WHEN 1 THEN 'recomendacion_caso_de_uso' WHEN 2 THEN 'comparativa' WHEN 3 THEN 'transaccional' ELSE 'informacional' END AS intent,
  'consulta ' || cast(doc_id % 20 as string) AS query, doc_id % 3 AS repetition,
  doc_id % 5 = 4 AS web_search,
  CASE WHEN doc_id % 50 = 0 THEN '' ELSE text END AS text,
  CASE WHEN doc_id % 50 = 0 THEN 'HTTP 429' ELSE '' END AS error
FROM {documents}
""",
)

DERIVED["framing_replies"] = (
    ("labels",),
    """
SELECT doc_id AS resp_id,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'Positivo.' WHEN quality = 1 THEN 'es CON_RESERVAS' WHEN toxic = 1 THEN 'Négativo' WHEN doc_id % 2 = 0 THEN 'neutro, no positivo' ELSE 'sin datos' END AS reply
FROM {labels}
""",
)

# One question of tone for each brand of an answer: they need not agree.
DERIVED["brand_replies"] = (
    ("framing_replies",),
    """
SELECT resp_id, 0 AS brand_no, reply FROM {framing_replies} UNION ALL SELECT resp_id, 1, CASE WHEN resp_id % 3 = 0 THEN 'negativo' ELSE reply END FROM {framing_replies}
UNION ALL SELECT resp_id, 2, CASE WHEN resp_id % 2 = 0 THEN 'Positivo' ELSE 'con_reservas' END FROM {framing_replies} WHERE resp_id % 5 <> 0 UNION ALL SELECT resp_id, 3, reply FROM {framing_replies} WHERE resp_id % 7 < 4
""",
)

DERIVED["snapshots"] = (
    ("event_log",),
    """
SELECT DISTINCT user_id % 20 AS site, cast(floor((unix_ts - 1704067200) / 86400) as bigint) AS crawl_day, '/u' || cast(user_id as string) AS url,
  CASE event_type WHEN 'view' THEN 'thin_content' WHEN 'signup' THEN 'h1_missing' WHEN 'error' THEN 'error_404' WHEN 'click' THEN 'title_missing' ELSE 'duplicate_title' END AS code
FROM {event_log}
""",
)
DERIVED["fetch_log"] = (
    ("event_log",),
    """
SELECT event_id, 'h' || cast(user_id % 20 as string) AS host, unix_ts, user_id,
  CASE WHEN event_type = 'error' THEN 429 ELSE 200 END AS status,
  CASE WHEN event_id % 4 = 1 THEN 'pronto' WHEN event_id % 2 = 0 THEN cast(cast(floor(value) as bigint) as string) ELSE '' END AS retry_after
FROM {event_log}
""",
)

DERIVED["links_graph"] = (
    ("lineitem", "part"),
    """
SELECT DISTINCT '/p' || cast(l_partkey as string) AS src, '/p' || cast((l_partkey * 7 + l_linenumber) % (SELECT count(*) FROM {part}) as string) AS dst
FROM {lineitem}
""",
)

# Addresses the user marked as important.
DERIVED["priority_list"] = (
    ("fetch_rows",),
    "SELECT DISTINCT url FROM {fetch_rows} WHERE url LIKE '%/en/%' AND url LIKE '%utm_source%'",
)

# Certificates: one per site, spread around the reference date; every seventh one is unreadable or refused.
DERIVED["certificates"] = (
    ("site_list",),
    """
SELECT site,
  CASE length(site) % 7 WHEN 0 THEN 'Jan 29 12:00:00 2024 GMT' WHEN 1 THEN 'Feb  8 06:00:00 2024 GMT' WHEN 2 THEN 'Aug 19 00:00:00 2024 GMT' WHEN 3 THEN 'pronto' WHEN 4 THEN '' ELSE 'Feb 14 23:59:59 2025 GMT' END AS not_after,
  length(site) % 7 <> 4 AS valid,
  CASE WHEN length(site) % 7 = 4 THEN 'handshake failure' ELSE '' END AS error,
  CASE WHEN length(site) % 2 = 0 THEN 'Autoridad Uno' ELSE '' END AS organization, 'CA ' || cast(length(site) % 3 as string) AS common_name
FROM {site_list}
""",
)

# The probe of the plain-http address of each site.
DERIVED["http_probes"] = (
    ("site_list",),
    """
SELECT site,
  CASE length(site) % 6 WHEN 0 THEN 'https://' || site || '/' WHEN 1 THEN 'http://' || site || '/' WHEN 2 THEN 'https://' || site || '/' WHEN 3 THEN 'https://' || site || '/' ELSE NULL END AS final_url,
  CASE length(site) % 6 WHEN 0 THEN '301' WHEN 2 THEN '301,302' ELSE '' END AS hop_statuses,
  CASE WHEN length(site) % 6 = 4 THEN 'Read timed out' ELSE '' END AS error
FROM {site_list}
""",
)

# Which sites publish llms.txt, have an encyclopedia entry, were fetched through the browser fallback.
DERIVED["site_signals"] = (
    ("site_list",),
    """
SELECT site, length(site) % 3 = 0 AS llms_txt, length(site) % 4 = 1 AS encyclopedia, length(site) % 8 = 5 AS browser_fallback,
  length(site) % 9 = 2 OR length(site) % 9 = 5 AS browser_unavailable
FROM {site_list}
""",
)

DERIVED["assets"] = (
    ("fetch_rows",),
    """
SELECT src, min(CASE WHEN k = 0 OR k = 20 THEN 404 WHEN k = 10 THEN NULL WHEN k = 15 THEN 503 ELSE 200 END) AS status
FROM (SELECT page_id % 40 AS k, regexp_extract(final_url, '^([a-z]+://[^/?#]*)', 1) || '/img/' || cast(page_id % 40 as string) || '.png' AS src
      FROM {fetch_rows} WHERE final_url <> '') a
GROUP BY src
""",
)

DERIVED["redirect_log"] = (
    ("fetch_rows",),
    """
SELECT url AS from_url, 301 AS status, url || '~1' AS location FROM {fetch_rows} WHERE hop_kind = 'single'
UNION SELECT url, 302, url || '~1' FROM {fetch_rows} WHERE hop_kind = 'temporary'
UNION SELECT url, 301, url || '~1' FROM {fetch_rows} WHERE hop_kind IN ('long', 'loop')
UNION SELECT url || '~1', 308, url || '~2' FROM {fetch_rows} WHERE hop_kind = 'long'
UNION SELECT url || '~2', 307, '/fin' FROM {fetch_rows} WHERE hop_kind = 'long'
UNION SELECT url || '~1', 301, url FROM {fetch_rows} WHERE hop_kind = 'loop'
UNION SELECT url || '~3', 304, url FROM {fetch_rows} WHERE hop_kind = 'loop'
UNION SELECT url || '~4', 301, '' FROM {fetch_rows} WHERE hop_kind = 'loop'
""",
)

DERIVED["event_log"] = (
    ("events",),
    "SELECT event_id, user_id, event_type, value, {epoch} AS unix_ts, {epoch_ms} AS unix_ms FROM {events}",
)

DERIVED["feed_docs"] = (
    ("documents",),
    """
SELECT doc_id, '<rss><channel><title>SEO</title><item><title>SEO y ' || head || '</title><link>https://n.example/' || cast(doc_id as string) || '</link><source url="https://diario.example.' || lang || '/x">Diario</source><pubDate>Mon, ' || cast(1 + doc_id % 28 as string) || ' Jan 2024 10:00:00 GMT</pubDate></item>'
  || '<item><title>Yoon-seo ' || head || '</title><link>https://n.example/y</link></item>'
  || '<item><title> Motores de Búsqueda: ' || cast(doc_id as string) || ' </title><link> https://n.example/m </link><pubDate>ayer</pubDate></item>'
  || '<item><title>ChatGPT sin enlace</title><link></link></item><item><title></title><link>https://n.example/z</link></item>'
  || '<item><title>LLM &amp; buscadores</title><link>https://n.example/l</link><source>Solo</source></item></channel></rss>' AS xml
FROM (SELECT doc_id, coalesce(lang, '') AS lang, replace(replace(coalesce(text, ''), '<', ''), '&', '') AS head FROM {documents}) d
""",
)

DERIVED["psi_payloads"] = (
    ("pages",),
    """
SELECT page_id, CASE WHEN page_id % 10 = 9 THEN '{{}}' ELSE
  '{{"lighthouseResult":{{"categories":{{"performance":{{"score":' || CASE WHEN page_id % 10 = 8 THEN 'null' ELSE '0.' || lpad(cast((page_id * 7) % 100 as string), 2, '0') END || '}}}},"audits":{{"largest-contentful-paint":{{"numericValue":' || cast(1000 + page_id % 3000 as string) || '.5}},"cumulative-layout-shift":{{"numericValue":0.' || cast(page_id % 9 as string) || '}},"first-contentful-paint":{{"numericValue":' || cast(length(html) as string) || '}}'
  || CASE WHEN page_id % 2 = 0 THEN ',"total-blocking-time":{{"numericValue":12}}' ELSE '' END || '}}}}}}' END AS payload
FROM {pages}
""",
)

DERIVED["battery_replies"] = (
    ("documents",),
    """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '```json' || chr(10) ELSE 'Claro: ' END
  || '{{"comparativa": [" ' || w1 || ' ", "", "' || w2 || '", "tercera", "cuarta", "quinta"], "transaccional": ["' || lang || '"], "otra": ["x"]}}'
  || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '```' WHEN doc_id % 7 = 1 THEN ' }} mal' ELSE ' fin' END AS reply
FROM (SELECT doc_id, lang, w1, upper(w1) AS w2 FROM (SELECT doc_id, coalesce(lang, '') AS lang, regexp_replace(coalesce(text, ''), '[^a-zA-Z]+', ' ') AS w1 FROM {documents}) t) d
""",
)

# Saved frontiers of interrupted crawls, one per user's last day of activity.
DERIVED["saved_frontiers"] = (
    ("event_log",),
    """
SELECT 'https://u' || cast(user_id as string) || '.example.com/' AS seed_url, count(*) AS pages_done,
  count(DISTINCT CASE WHEN event_type = 'click' THEN event_id % 50 END) AS pending, max(unix_ts) + user_id % 3 * 86400 - 432000 AS saved_at
FROM {event_log} GROUP BY user_id
""",
)

# Findings turned into work items.
DERIVED["backlog"] = (
    ("event_log",),
    """
SELECT event_id, 'h' || cast(user_id % 20 as string) AS site,
  CASE event_type WHEN 'error' THEN 'critical' WHEN 'click' THEN 'warning' WHEN 'view' THEN 'info' ELSE 'unknown' END AS severity,
  CASE WHEN event_id % 4 = 0 THEN 'Por hacer' WHEN event_id % 4 = 1 THEN 'En progreso' WHEN event_id % 4 = 2 THEN 'Hecho' ELSE 'Por hacer' END AS status
FROM {event_log}
""",
)

BASE_TABLES = ("pages", "documents", "conversations", "events", "lineitem", "labels", "orders", "part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, or one derived from the supplied tables (a plan, built once per application)."""
    return _table(spark.sparkContext.applicationId, sf_dir, name)


@lru_cache(maxsize=256)
def _table(application: str, sf_dir: str, name: str) -> DataFrame:
    spark = SparkSession.active()
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs, text = DERIVED[name]
    text = text.replace("{epoch}", "cast(floor(unix_micros(cast(ts as timestamp)) / 1000000) as bigint)").replace(
        "{epoch_ms}", "unix_millis(cast(ts as timestamp))"
    )
    return spark.sql(text, **{i: _table(application, sf_dir, i) for i in inputs})


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page archive as a crawl delivers it: headers as a map, redirect hops as an array."""
    rows = table(spark, sf_dir, "fetch_rows")
    url = F.col("url")

    def hop(address, status: int):
        return F.struct(address.alias("url"), F.lit(status).alias("status"))

    chain = (
        F.when(F.col("hop_kind") == "single", F.array(hop(url, 301)))
        .when(F.col("hop_kind") == "temporary", F.array(hop(url, 302)))
        .when(F.col("hop_kind") == "long", F.array(hop(url, 301), hop(F.concat(url, F.lit("~1")), 308), hop(F.concat(url, F.lit("~2")), 307)))
        .when(F.col("hop_kind") == "loop", F.array(hop(url, 301), hop(F.concat(url, F.lit("~1")), 301), hop(url, 301)))
        .otherwise(F.array().cast("array<struct<url:string,status:int>>"))
    )
    headers = F.map_filter(
        F.create_map(
            F.lit("content-type"), F.col("content_type"), F.lit("server"), F.col("server"),
            F.lit("x-robots-tag"), F.col("x_robots_tag"),
        ),
        lambda k, v: (v != "") & F.col("status").isNotNull(),
    )
    return rows.select(
        "page_id", "site", "url", "status", "final_url", "content_type", "x_robots_tag", "error", "depth", "fetch_ms",
        headers.alias("headers"), chain.alias("redirect_chain"), "html",
    )


def sitemap_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap files: an index per site (also listing itself and a missing file), its parts, and one broken file."""
    parts = table(spark, sf_dir, "sitemap_parts")
    root = F.concat(F.lit("https://"), F.col("site"), F.lit("/"))
    ns = '<?xml version="1.0"?><{} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    urlset = parts.groupBy("site", "part").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("page_id", "loc"))).getField("loc"), "</loc></url><url><loc>").alias("locs")
    )
    part_url = F.concat(root, F.lit("sitemap-"), F.col("part").cast("string"), F.lit(".xml"))
    files = urlset.select(
        "site",
        part_url.alias("sitemap_url"),
        F.lit(200).alias("status"),
        F.concat(
            F.lit(ns.format("urlset") + "<url><loc>"), "locs", F.lit("</loc></url><url><loc> "), root, F.lit("huerfana-a </loc></url><url><loc>"),
            root, F.lit("huerfana-b</loc></url><url><loc>https://fuera.example.info/x</loc></url><url><lastmod>2024</lastmod></url></urlset>"),
        ).alias("xml"),
    )
    index = urlset.groupBy("site").agg(F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: F.concat(
        F.lit("<sitemap><loc>https://"), F.col("site"), F.lit("/sitemap-"), p.cast("string"), F.lit(".xml</loc></sitemap>"))), "").alias("children"))
    indexes = index.select(
        "site", F.concat(root, F.lit("sitemap_index.xml")).alias("sitemap_url"), F.lit(200).alias("status"),
        F.concat(
            F.lit(ns.format("sitemapindex")), "children", F.lit("<sitemap><loc>"), root, F.lit("sitemap_index.xml</loc></sitemap><sitemap><loc>"), root,
            F.lit("falta.xml</loc></sitemap><sitemap><loc>"), root, F.lit("rota.xml</loc></sitemap></sitemapindex>"),
        ).alias("xml"),
    )
    broken = index.select("site", F.concat(root, F.lit("rota.xml")).alias("sitemap_url"), F.lit(200).alias("status"),
                          F.concat(F.lit("<html><url><loc>"), root, F.lit("</loc></url></html>")).alias("xml"))
    missing = index.select("site", F.concat(root, F.lit("falta.xml")).alias("sitemap_url"), F.lit(404).alias("status"), F.lit("").alias("xml"))
    # sites whose robots file names no sitemap are asked for the default address
    default = index.where(F.length("site") % 5 == 3).select(
        "site", F.concat(root, F.lit("sitemap.xml")).alias("sitemap_url"), F.lit(200).alias("status"),
        F.concat(F.lit(ns.format("urlset") + "<url><loc>"), root, F.lit("</loc></url></urlset>")).alias("xml"),
    )
    return files.unionByName(indexes).unionByName(broken).unionByName(missing).unionByName(default)
