"""Page facts: one narrow row per fetched page, computed in the scan without a shuffle.

The HTML is read once and projected away here, so nothing downstream ever carries it through an exchange.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from auditlake.functions import html as H, text as X, urls as U
from auditlake.functions.binding import unpack
from auditlake.functions.tags import repaired



def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def is_html(status: Column, content_type: Column, html: Column) -> Column:
    return F.coalesce((status == 200) & content_type.contains("text/html") & (html != ""), F.lit(False))


@lru_cache(maxsize=2)
def _parse_columns(application: str) -> dict[str, Column]:
    """Tag arrays and text of the column ``doc``.  Columns are built once per application: composing them costs
    far more driver time than planning them."""
    doc = F.col("doc")
    return {
        "title": H.title(doc),
        "metas": H.open_tags(doc, "meta"),
        "head_links": H.open_tags(doc, "link"),
        "imgs": H.open_tags(doc, "img"),
        "anchors": H.anchor_parts(H.elements(doc, "a")),
        "linked": H.anchor_parts(H.elements(H.without_noscript(doc), "a")),
        "base": U.base_parts(F.col("final_url")),
        "h1": H.heading_texts(doc, "h1"),
        "h2": H.heading_texts(doc, "h2"),
        "text": H.visible_text(doc),
    }


@lru_cache(maxsize=2)
def _fact_columns(application: str) -> dict[str, Column]:
    base, html = F.col("base"), F.col("html")
    real = html != ""
    return {
        "error_type": F.when(F.col("status").isNull(), X.fetch_error_class(F.col("error"))).otherwise(F.lit("")),
        "meta_description": H.meta_content(F.col("metas"), "description"),
        "meta_robots": H.meta_content(F.col("metas"), "robots"),
        "meta_keywords": H.meta_content(F.col("metas"), "keywords"),
        "canonical": H.canonical(F.col("head_links"), base),
        "hreflang": H.hreflang(F.col("head_links"), base),
        "json_ld_types": H.json_ld_types(html),
        "images_without_alt": H.images_without_alt(F.col("imgs")),
        "image_srcs": H.image_sources(F.col("imgs"), base),
        "empty_anchors": H.empty_anchor_count(F.col("anchors")),
        "outlinks": H.outlinks(F.col("linked"), base),
        "content_hash": F.when(real, H.content_hash(F.col("text"))).otherwise(F.lit("")),
        "meta_refresh": H.meta_refresh_target(html),
        "js_redirect": H.js_redirect(html),
        "tech": F.when(real, H.technologies(F.col("haystack"), html)).otherwise(_empty("string")),
        "is_soft_404": H.soft_404(F.col("status"), F.col("title"), F.col("text"), F.col("word_count")),
    }


FETCH_COLUMNS = [
    "page_id", "site", "url", "status", "final_url", "content_type", "x_robots_tag", "error", "depth", "fetch_ms",
    "headers", "redirect_chain",
]


def page_facts(fetches: DataFrame, keep_text: bool = False, carry: list[str] = []) -> DataFrame:
    """Every per-page fact the rules, rankings and graphs need; pages that are not HTML get empty facts.

    ``carry`` names further columns of ``fetches`` that are passed on.
    """
    application = fetches.sparkSession.sparkContext.applicationId
    usable = is_html(F.col("status"), F.col("content_type"), F.col("html"))
    docs = fetches.withColumn("html", F.when(usable, F.col("html")).otherwise(F.lit(""))).withColumn(
        "doc", repaired(H.markup(F.col("html")))
    )
    parse = _parse_columns(application)
    tags = docs.select(*FETCH_COLUMNS, *carry, "html", *[c.alias(n) for n, c in parse.items()])
    header_blob = F.array_join(
        F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit(": "), e.value)), " "
    )
    tags = tags.withColumns(
        {"haystack": F.lower(F.concat("html", F.lit(" "), header_blob)), "word_count": H.word_count(F.col("text"))}
    )
    return tags.select(
        *FETCH_COLUMNS, *carry, "title", "h1", "h2", "word_count", *(["text"] if keep_text else []),
        *[c.alias(n) for n, c in _fact_columns(application).items()],
    )


BLOCKED_ERROR = "Bloqueado por robots.txt"  # fixed value


def without_blocked(facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Facts with those of denied pages emptied: a denied page has its address and depth, no answer, facts or links.

    ``verdicts``: page_id, is_blocked; a page without one is allowed.  Adds ``is_blocked``.
    """
    denied = F.col("is_blocked")
    nothing = {"string": F.lit(""), "boolean": F.lit(False), "double": F.lit(0.0), "int": F.lit(0), "bigint": F.lit(0)}
    kept = {"page_id", "site", "url", "depth"}
    special = {"status": F.lit(None), "error": F.lit(BLOCKED_ERROR)}
    out = facts.join(verdicts.select("page_id", "is_blocked"), "page_id", "left").withColumn("is_blocked", F.coalesce(denied, F.lit(False)))
    blank = {}
    for field in facts.schema:
        if field.name not in kept:
            kind = field.dataType.simpleString()
            empty = special.get(field.name, nothing.get(kind))
            if empty is None:
                empty = F.create_map().cast(kind) if kind.startswith("map") else F.array()
            blank[field.name] = F.when(denied, empty.cast(kind)).otherwise(F.col(field.name))
    return out.withColumns(blank)


def is_indexable() -> Column:
    robots = F.lower(F.concat("meta_robots", F.lit(" "), "x_robots_tag"))
    canonical_ok = (F.col("canonical") == "") | (F.col("canonical") == F.col("final_url")) | (F.col("canonical") == F.col("url"))
    return F.coalesce((F.col("status") == 200) & ~robots.contains("noindex") & canonical_ok, F.lit(False))


def page_links(facts: DataFrame) -> DataFrame:
    """Edge table in document order."""
    edges = facts.select("page_id", "site", F.col("final_url").alias("source"), "depth", "outlinks")
    return unpack(edges, "outlinks", "link", "link_pos").select(
        "page_id", "site", "source", "depth", "link_pos",
        F.col("link.target").alias("target"),
        F.col("link.anchor_text").alias("anchor_text"),
        F.col("link.rel").alias("rel"),
        U.is_same_site(F.col("source"), F.col("link.target"), True).alias("is_internal"),
    )


def parsed_anchors(fetches: DataFrame) -> DataFrame:
    """href of every ``<a>`` element with the base it resolves against."""
    usable = is_html(F.col("status"), F.col("content_type"), F.col("html"))
    doc = repaired(H.markup(F.when(usable, F.col("html")).otherwise(F.lit(""))))
    hrefs = F.transform(H.elements(F.col("doc"), "a"), lambda a: H.attr(H.start_tag(a), "href"))
    return fetches.withColumn("doc", doc).select("page_id", U.base_parts(F.col("final_url")).alias("base"), hrefs.alias("hrefs"))
