"""Page-fact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions.binding import unpack
from auditlake.operators import facts as page_facts
from auditlake.plans import duck as D, inputs as I
from auditlake.plans.registry import query

u = F.col

D.CTES["ld_items"] = r"""
SELECT page_id, unnest(items) AS item, generate_subscripts(items, 1) AS item_no FROM (
  SELECT page_id, CASE WHEN json_type(block) = 'ARRAY' THEN json_extract(block, '$[*]') ELSE [block::json] END AS items FROM (
    SELECT page_id, unnest(regexp_extract_all(src, '(?is)<script\s[^>]*type\s*=\s*"application/ld\+json"[^>]*>(.*?)</script\s*>', 1)) AS block FROM docs) WHERE json_valid(block))
"""


@query("page_facts", """
SELECT f.page_id, f.site, f.url, f.status, f.title, f.meta_description, array_to_string(f.h1, '|') AS h1, f.canonical, f.word_count, f.content_hash, f.images_without_alt,
  f.empty_anchors, f.is_soft_404, f.error_type, f.n_hops FROM facts f""")
def facts(spark, sf):
    return I.facts(spark, sf).select(
        "page_id", "site", "url", "status", "title", "meta_description", I.text_of("h1").alias("h1"), "canonical", "word_count", "content_hash",
        "images_without_alt", "empty_anchors", "is_soft_404", "error_type", F.size("redirect_chain").alias("n_hops"))


@query("page_meta", "SELECT page_id, meta_description, meta_robots, meta_keywords, canonical FROM facts")
def page_meta(spark, sf):
    return I.facts(spark, sf).select("page_id", "meta_description", "meta_robots", "meta_keywords", "canonical")


@query("page_headings", "SELECT page_id, title, array_to_string(h1, '|') AS h1, array_to_string(h2, '|') AS h2, len(h1) AS n_h1, len(h2) AS n_h2 FROM facts")
def page_headings(spark, sf):
    return I.facts(spark, sf).select("page_id", "title", I.text_of("h1").alias("h1"), I.text_of("h2").alias("h2"), F.size("h1").alias("n_h1"), F.size("h2").alias("n_h2"))


@query("page_hreflang", f"""
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS pos, lang, {D.resolve('href', 'final_url')} AS href FROM (
  SELECT page_id, final_url, n, {D.attr('l', 'rel')} AS rel, {D.attr('l', 'hreflang')} AS lang, {D.attr('l', 'href')} AS href
  FROM (SELECT page_id, final_url, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM (SELECT page_id, final_url, {D.tags('doc', 'link')} AS ls FROM docs)))
WHERE rel = 'alternate' AND lang <> '' AND href <> ''""")
def page_hreflang(spark, sf):
    return unpack(I.facts(spark, sf).select("page_id", "hreflang"), "hreflang", "h", "pos").select("page_id", "pos", "h.lang", "h.href")


@query("page_json_ld", r"""
SELECT page_id, string_agg(t, ',' ORDER BY item_no, kind, type_no) AS types FROM (
  SELECT page_id, item_no, 0 AS kind, unnest(CASE json_type(item, '$."@type"') WHEN 'ARRAY' THEN json_extract_string(item, '$."@type"[*]') WHEN 'VARCHAR' THEN [json_extract_string(item, '$."@type"')] ELSE [] END) AS t,
    generate_subscripts(CASE json_type(item, '$."@type"') WHEN 'ARRAY' THEN json_extract_string(item, '$."@type"[*]') WHEN 'VARCHAR' THEN [json_extract_string(item, '$."@type"')] ELSE [] END, 1) AS type_no FROM ld_items
  UNION ALL SELECT page_id, item_no, 1, unnest(json_extract_string(item, '$."@graph"[*]."@type"')), generate_subscripts(json_extract_string(item, '$."@graph"[*]."@type"'), 1) FROM ld_items)
GROUP BY page_id""")
def page_json_ld(spark, sf):
    return I.facts(spark, sf).where(F.size("json_ld_types") > 0).select("page_id", I.text_of("json_ld_types", ",").alias("types"))


@query("page_images", """
SELECT f.page_id, f.images_without_alt, coalesce((SELECT string_agg(i.src, ' ' ORDER BY i.n) FROM image_rows i WHERE i.page_id = f.page_id), '') AS srcs FROM facts f""")
def page_images(spark, sf):
    return I.facts(spark, sf).select("page_id", "images_without_alt", I.text_of("image_srcs", " ").alias("srcs"))


@query("page_anchors", "SELECT f.page_id, f.empty_anchors, coalesce(l.n, 0) AS n_links FROM facts f LEFT JOIN (SELECT page_id, count(*) AS n FROM links GROUP BY 1) l ON l.page_id = f.page_id")
def page_anchors(spark, sf):
    return I.facts(spark, sf).select("page_id", "empty_anchors", F.size("outlinks").alias("n_links"))


@query("page_text", "SELECT page_id, text, word_count, content_hash FROM facts")
def page_text(spark, sf):
    return I.facts(spark, sf, keep_text=True).select("page_id", "text", "word_count", "content_hash")


@query("page_links", "SELECT page_id, source, link_pos, target, anchor_text, rel, is_internal FROM links")
def page_links(spark, sf):
    return page_facts.page_links(I.facts(spark, sf)).select("page_id", "source", "link_pos", "target", "anchor_text", "rel", "is_internal")


@query("page_client_redirects", "SELECT page_id, meta_refresh, js_redirect FROM facts")
def page_client_redirects(spark, sf):
    return I.facts(spark, sf).select("page_id", "meta_refresh", "js_redirect")


@query("page_tech", "SELECT f.page_id, coalesce(array_to_string(t.tech, ', '), '') AS tech FROM facts f LEFT JOIN tech_rows t ON t.page_id = f.page_id")
def page_tech(spark, sf):
    return I.facts(spark, sf).select("page_id", I.text_of("tech", ", ").alias("tech"))


@query("page_soft_404", "SELECT page_id, status, word_count, is_soft_404 FROM facts")
def page_soft_404(spark, sf):
    return I.facts(spark, sf).select("page_id", "status", "word_count", "is_soft_404")


@query("indexable_pages", "SELECT page_id, is_indexable FROM facts")
def indexable_pages(spark, sf):
    return I.facts(spark, sf).select("page_id", page_facts.is_indexable().alias("is_indexable"))
