"""Facts from raw HTML as column expressions.

Extraction is by regular expression over the whole document, in the JVM without a parser call.  The patterns expect every
element to be ended; ``tags.repaired`` sees to that where a page leaves end tags out or crosses them.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, functions as F

from auditlake.functions.binding import let
from auditlake.functions.urls import resolve_against, scheme

# Unicode white space as the complement of everything else: the common letters are tested first, and the class
# means the same in every regex dialect.
_VISIBLE = (
    r"\x{0021}-\x{0084}\x{00a1}-\x{167f}\x{0086}-\x{009f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}"
    r"\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}\x{0002}-\x{0008}\x{000e}-\x{001b}\x{0000}"
)
VISIBLE = rf"[{_VISIBLE}\x{{0001}}]"
WS = rf"[^{_VISIBLE}\x{{0001}}]"
WS_OR_NODE = rf"[^{_VISIBLE}]"
NODE = "\u0001"  # marks a text-node boundary
# The same sets for Spark alone: one test by character type instead of a chain of ranges, and the characters for trimming.
_BLANK = r"\s\x1c\x1d\x1e\x1f"
_BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Every named entity of HTML 5 as one text, each name and value between marks; ``amp`` is decoded after all others.
# What pages are full of comes first: the text is searched from its start.
_COMMON = {f"{name};": at for at, name in enumerate("quot lt gt nbsp apos aacute eacute iacute oacute uacute ntilde laquo raquo copy hellip ndash mdash".split())}
_NAMES = "\u0002" + "".join(
    f"{name[:-1]}\u0003{value}\u0002" for name, value in sorted(html5.items(), key=lambda e: (_COMMON.get(e[0], len(_COMMON)), e)) if name.endswith(";") and name != "amp;")
# References to the C1 block mean the characters of the Windows code page.
_C1 = {i: ord(c) for i in range(0x80, 0xA0) if (c := bytes([i]).decode("cp1252", "replace")) != "\ufffd"}


def trim_ws(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal references, each replaced throughout; text without ``&`` is left alone.

    An unknown name stays; a number that is no character becomes the replacement character.
    """
    c1 = F.create_map(*[F.lit(x) for pair in _C1.items() for x in pair])

    def numbered(code: Column) -> Column:
        hexadecimal = code.rlike("^#[xX]")
        point = F.when(hexadecimal, F.conv(F.substring(code, F.lit(3), F.lit(8)), 16, 10)).otherwise(F.substring(code, F.lit(2), F.lit(8))).try_cast("int")
        point = F.coalesce(F.try_element_at(c1, point), point)
        wrong = (point < 1) | (point > 0x10FFFF) | point.between(0xD800, 0xDFFF)
        return F.when(wrong, F.lit("\ufffd")).otherwise(F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32"))

    def named(code: Column) -> Column:
        key = F.concat(F.lit("\u0002"), code, F.lit("\u0003"))

        def value(at: Column) -> Column:
            rest = F.substring(F.lit(_NAMES), at + F.char_length(key), F.lit(8))
            return F.when(at > 0, F.substring_index(rest, "\u0002", 1))

        return let(F.instr(F.lit(_NAMES), key), value)

    def replacement(code: Column) -> Column:
        return F.when(code.startswith("#"), numbered(code)).otherwise(named(code))

    def decoded(t: Column) -> Column:
        codes = F.array_distinct(F.regexp_extract_all(t, F.lit("&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"), F.lit(1)))
        filled = F.aggregate(
            F.filter(codes, lambda c: c != "amp"),
            t,
            lambda acc, c: F.coalesce(F.replace(acc, F.concat(F.lit("&"), c, F.lit(";")), replacement(c)), acc),
        )
        return F.when(t.contains("&"), F.replace(filled, F.lit("&amp;"), F.lit("&"))).otherwise(t)

    return let(text, decoded)


def markup(html: Column) -> Column:
    """The document without comments, scripts and style sheets (their text is never an element)."""
    return F.regexp_replace(
        html,
        r"(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>",
        NODE,
    )


def without_noscript(doc: Column) -> Column:
    return F.regexp_replace(doc, r"(?is)<noscript(?:\s[^>]*)?>.*?</noscript\s*>", NODE)


def _split_nodes(fragment: Column, glue: str) -> Column:
    marked = decode_entities(F.regexp_replace(fragment, r"<[!?/a-zA-Z][^>]*>", NODE))
    # a run of blanks is looked at from its start only, so long runs cost no more than they are long
    joined = F.regexp_replace(marked, rf"(?U)(?<![{_BLANK}])[{_BLANK}]*{NODE}[{_BLANK}{NODE}]*", glue)
    return trim_ws(joined)


def visible_text(doc: Column) -> Column:
    """Text nodes, each trimmed, joined by one space.  The title is part of it."""
    return _split_nodes(without_noscript(doc), " ")


def inner_text(fragment: Column) -> Column:
    """Text of one element: trimmed nodes glued together without a separator."""
    return _split_nodes(fragment, "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"(?U)[^{_BLANK}]+"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def raw_attr(tag: Column, name: str) -> Column:
    """Attribute value of a start tag as written, quotes removed; empty when absent."""
    raw = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.regexp_replace(raw, r"^[\"']|[\"']$", "")


def attr(tag: Column, name: str) -> Column:
    return decode_entities(raw_attr(tag, name))


def open_tags(doc: Column, name: str) -> Column:
    return F.regexp_extract_all(doc, F.lit(rf"(?is)<{name}(?:[\s/][^>]*)?>"), F.lit(0))


def elements(doc: Column, name: str) -> Column:
    return F.regexp_extract_all(doc, F.lit(rf"(?is)<{name}(?:\s[^>]*)?>.*?</{name}\s*>"), F.lit(0))


def start_tag(element: Column) -> Column:
    return F.regexp_extract(element, r"(?is)^(<[^>]*>)", 1)


def title(doc: Column) -> Column:
    return inner_text(F.regexp_extract(doc, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1))


def meta_content(metas: Column, name: str) -> Column:
    """``content`` of the first meta tag of that name; ``metas`` is the array of meta tags."""
    hit = F.get(F.filter(metas, lambda m: F.lower(raw_attr(m, "name")) == name), F.lit(0))
    return F.coalesce(trim_ws(attr(hit, "content")), F.lit(""))


def heading_texts(doc: Column, level: str) -> Column:
    return F.transform(elements(doc, level), inner_text)


def _has_rel(link: Column, value: str) -> Column:
    return F.array_contains(F.split(F.lower(raw_attr(link, "rel")), r"\s+"), value)


def canonical(links: Column, base: Column) -> Column:
    """``base`` here and below is a ``base_parts`` struct."""
    href = trim_ws(attr(F.get(F.filter(links, lambda l: _has_rel(l, "canonical")), F.lit(0)), "href"))
    return let(F.coalesce(href, F.lit("")), lambda h: F.when(h == "", h).otherwise(resolve_against(h, base)))


def hreflang(links: Column, base: Column) -> Column:
    usable = F.filter(
        links, lambda l: _has_rel(l, "alternate") & (raw_attr(l, "hreflang") != "") & (raw_attr(l, "href") != "")
    )
    return F.transform(
        usable,
        lambda l: F.struct(attr(l, "hreflang").alias("lang"), resolve_against(attr(l, "href"), base).alias("href")),
    )


def images_without_alt(imgs: Column) -> Column:
    return F.size(F.filter(imgs, lambda i: trim_ws(attr(i, "alt")) == ""))


def image_sources(imgs: Column, base: Column) -> Column:
    srcs = F.transform(imgs, lambda i: trim_ws(attr(i, "src")))
    usable = F.filter(srcs, lambda s: (s != "") & ~F.lower(s).startswith("data:"))
    return F.array_distinct(F.transform(usable, lambda s: resolve_against(s, base, keep_fragment=True)))


def anchor_parts(anchors: Column) -> Column:
    """href, text, rel and whether an image is inside, for each ``<a>`` element."""
    return F.transform(
        anchors,
        lambda a: F.struct(
            trim_ws(attr(start_tag(a), "href")).alias("href"),
            inner_text(a).alias("anchor_text"),
            raw_attr(start_tag(a), "rel").alias("rel"),
            a.rlike(r"(?i)<img[\s/>]").alias("has_image"),
        ),
    )


def empty_anchor_count(parts: Column) -> Column:
    return F.size(F.filter(parts, lambda p: (p.href == "") | ((p.anchor_text == "") & ~p.has_image)))


def outlinks(parts: Column, base: Column) -> Column:
    """Links in document order: target, anchor text and rel; only http(s) targets survive."""
    kept = F.filter(parts, lambda p: (p.href != "") & ~p.href.rlike("^(javascript:|mailto:|tel:|#)"))
    resolved = F.transform(
        kept,
        lambda p: F.struct(
            resolve_against(p.href, base).alias("target"), p.anchor_text.alias("anchor_text"), p.rel.alias("rel")
        ),
    )
    return F.filter(resolved, lambda p: scheme(p.target).isin("http", "https"))


def json_ld_types(html: Column) -> Column:
    """``@type`` values of every JSON-LD block: objects, arrays, list-valued types and ``@graph`` members."""
    blocks = F.regexp_extract_all(
        F.regexp_replace(html, r"(?is)<!--.*?-->", ""),
        F.lit(r"(?is)<script\s[^>]*type\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"),
        F.lit(1),
    )

    def items(block: Column) -> Column:
        data = F.try_parse_json(block)
        many = F.try_variant_get(data, "$", "array<variant>")
        return F.coalesce(many, F.array(data))

    def types(item: Column) -> Column:
        plain = F.try_variant_get(item, "$['@type']", "variant")
        listed = F.try_variant_get(item, "$['@type']", "array<string>")
        single = F.when(F.schema_of_variant(plain) == "STRING", F.array(plain.cast("string")))
        graph = F.coalesce(F.try_variant_get(item, "$['@graph']", "array<variant>"), F.array().cast("array<variant>"))
        members = F.transform(graph, lambda g: F.try_variant_get(g, "$['@type']", "variant"))
        member_types = F.transform(
            F.filter(members, lambda m: F.schema_of_variant(m) == "STRING"), lambda m: m.cast("string")
        )
        own = F.coalesce(listed, single, F.array().cast("array<string>"))
        return F.concat(own, member_types)

    return F.flatten(F.transform(F.flatten(F.transform(blocks, items)), types))


def meta_refresh_target(html: Column) -> Column:
    # Fixed pattern: a refresh meta tag whose content carries a url.
    return trim_ws(
        F.regexp_extract(
            html,
            r"(?i)<meta[^>]+http-equiv=[\"']?refresh[\"']?[^>]*content=[\"']?\s*[0-9]+\s*;\s*url=([^\"'>]+)",
            1,
        )
    )


def js_redirect(html: Column) -> Column:
    # Fixed pattern: assignments to the document location.
    return html.rlike(r"(?i)window\.location(\.href)?\s*=|window\.location\.replace\s*\(|document\.location\s*=")


# Technology fingerprints, matched case-insensitively in the page and its headers.
TECH_MARKERS = [
    ("WordPress", ["wp-content", "wp-includes", "/wp-json/"]),
    ("WooCommerce", ["woocommerce"]),
    ("Shopify", ["cdn.shopify.com", "shopify.com/s/", "x-shopid"]),
    ("Wix", ["static.wixstatic.com", "wix.com"]),
    ("Squarespace", ["squarespace.com", "static1.squarespace.com"]),
    ("Webflow", ["webflow.com", "assets.website-files.com"]),
    ("Drupal", ["sites/default/files", "/drupal.js", "x-generator: drupal"]),
    ("Joomla", ["/media/jui/", "joomla"]),
    ("Magento", ["mage/cookies", "magento"]),
    ("PrestaShop", ["prestashop"]),
    ("Next.js", ["__next_data__", "/_next/static"]),
    ("Nuxt.js", ["__nuxt__", "/_nuxt/"]),
    ("React", ["data-reactroot", "react-dom"]),
    ("Vue.js", ["data-v-app", "__vue__"]),
    ("Angular", ["ng-version"]),
    ("Google Tag Manager", ["googletagmanager.com/gtm.js"]),
    ("Google Analytics", ["google-analytics.com", "gtag('config'"]),
    ("Cloudflare", ["cf-ray", "cloudflare"]),
    ("Nginx", ["server: nginx"]),
    ("Apache", ["server: apache"]),
]


def technologies(haystack: Column, html: Column) -> Column:
    """``haystack`` is the lower-cased page followed by ``name: value`` headers."""

    def any_of(markers: list[str]) -> Column:
        hit = haystack.contains(markers[0])
        for m in markers[1:]:
            hit = hit | haystack.contains(m)
        return hit

    found = F.array_compact(F.array(*[F.when(any_of(ms), F.lit(name)) for name, ms in TECH_MARKERS]))
    # fixed value: the pattern
    generator = trim_ws(
        F.regexp_extract(html, r"(?i)<meta[^>]+name=[\"']generator[\"'][^>]+content=[\"']([^\"']+)", 1)
    )
    return F.when(generator == "", found).otherwise(F.array_union(found, F.array(generator)))


# Phrases of a not-found page.
NOT_FOUND = (
    r"(?iu)p[aá]gina no encontrada|no se encontr[oó]|no existe esta p[aá]gina|contenido no disponible"
    r"|page not found|not found|error 404|404 error|we can.?t find"
)
SOFT_404_WORDS = 60


def soft_404(status: Column, title_col: Column, text: Column, words: Column) -> Column:
    # a phrase in the title is one of the whole; long texts need not be searched
    whole = F.concat(title_col, F.lit(" "), text)
    return F.coalesce(status == 200, F.lit(False)) & (title_col.rlike(NOT_FOUND) | ((words <= SOFT_404_WORDS) & whole.rlike(NOT_FOUND)))
