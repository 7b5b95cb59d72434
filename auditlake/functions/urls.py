"""URL columns.  Everything is a regular expression or an array fold, so it stays inside the JVM.

``parse_url`` is avoided on purpose: under ANSI mode it raises on the malformed links real pages carry.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from auditlake.functions import domains
from auditlake.functions.binding import let

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, rf"^({_SCHEME}):", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, rf"^(?:{_SCHEME}:)?//([^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(authority(url))


def path(url: Column) -> Column:
    """Path without the ``;params`` of its last segment."""
    return F.regexp_extract(url, rf"(?s)^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*?)(?:;[^/?#]*)?(?:[?#].*)?$", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


def strip_www(host_col: Column) -> Column:
    return F.regexp_replace(host_col, r"^(?i:www\.)", "")


def is_https(url: Column) -> Column:
    return scheme(url) == "https"


def is_www(url: Column) -> Column:
    return host(url).startswith("www.")


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def registrable_domain(url: Column, suffixes: domains.Suffixes = domains.COMMON) -> Column:
    """Public suffix plus one label, by a table that the caller may replace."""
    return domains.registrable_domain(authority(url), suffixes)


def site_key(url: Column, include_subdomains: bool = False) -> Column:
    """Unit of an audit: the registrable domain, or the host without ``www.``."""
    return registrable_domain(url) if include_subdomains else strip_www(host(url))


def is_same_site(a: Column, b: Column, include_subdomains: bool = False) -> Column:
    return site_key(a, include_subdomains) == site_key(b, include_subdomains)


def partition_slug(url: Column) -> Column:
    """Registrable domain made safe for a partition directory name."""
    domain = strip_www(registrable_domain(url))
    return F.regexp_replace(F.when(domain == "", F.lit("sitio")).otherwise(domain), r"[^\p{L}\p{N}.\-]", "_")


def host_slug(url: Column) -> Column:
    key = F.replace(host(url), F.lit(":"), F.lit("_"))
    return F.when(key == "", F.lit("unknown")).otherwise(key)


def name_slug(name: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(slug == "", F.lit("marca")).otherwise(slug)


def has_trailing_slash(url: Column) -> Column:
    p = path(url)
    return ~p.isin("", "/") & p.endswith("/")


def _with_path(url: Column, new_path: Column) -> Column:
    tail = F.regexp_extract(url, r"(?s)^[^?#]*?(;[^/?#]*)?([?#].*)?$", 1)
    rest = F.regexp_extract(url, r"(?s)^[^?#]*([?#].*)?$", 1)
    lead = F.regexp_extract(url, rf"^((?:{_SCHEME}:)?(?://[^/?#]*)?)", 1)
    return F.concat(lead, new_path, tail, rest)


def swap_scheme(url: Column, new_scheme: str) -> Column:
    return F.regexp_replace(url, rf"^{_SCHEME}:", f"{new_scheme}:")


def swap_www(url: Column, want_www: bool) -> Column:
    bare = F.regexp_replace(url, rf"^({_SCHEME}://)(?i:www\.)", "$1")
    return F.regexp_replace(bare, rf"^({_SCHEME}://)", "$1www.") if want_www else bare


def toggle_trailing_slash(url: Column) -> Column:
    p = path(url)
    flipped = (
        F.when((p != "/") & p.endswith("/"), F.regexp_replace(p, "/$", ""))
        .when(p == "", F.lit("/"))
        .otherwise(F.concat(p, F.lit("/")))
    )
    return _with_path(url, flipped)


def variants(url: Column) -> Column:
    """The addresses that should all lead to one page: scheme, www and slash swapped."""
    return F.array(
        F.struct(F.lit("http").alias("kind"), swap_scheme(url, "http").alias("variant")),
        F.struct(F.lit("https").alias("kind"), swap_scheme(url, "https").alias("variant")),
        F.struct(F.lit("www").alias("kind"), swap_www(url, True).alias("variant")),
        F.struct(F.lit("bare").alias("kind"), swap_www(url, False).alias("variant")),
        F.struct(F.lit("slash").alias("kind"), toggle_trailing_slash(url).alias("variant")),
    )


def variant_key(url: Column) -> Column:
    """One key for every address that differs only in scheme, ``www.`` or trailing slash."""
    q = query(url)
    return F.concat(
        strip_www(host(url)),
        F.regexp_replace(path(url), "/$", ""),
        F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)),
    )


def query_param_count(url: Column) -> Column:
    """Distinct parameter names; parameters with a blank value do not count."""
    pairs = F.filter(F.split(query(url), "&"), lambda kv: kv.rlike("^[^=]*=.+"))
    return F.size(F.array_distinct(F.transform(pairs, lambda kv: F.regexp_extract(kv, "^([^=]*)=", 1))))


def start_folder(url: Column) -> Column:
    return F.concat(F.regexp_replace(path(url), "/?[^/]*$", ""), F.lit("/"))


def convention_flags(url: Column) -> dict[str, Column]:
    p = path(url)
    return {
        "url_uppercase": p != F.lower(p),
        "url_underscore": p.contains("_"),
        "url_multi_slash": p.contains("//"),
        # a digit or a character outside the plain URL alphabet, in any segment
        "url_numeric_or_special": p.rlike(r"[0-9]|[^a-zA-Z0-9\-/._~%:]"),
    }


def _fold_dots(p: Column) -> Column:
    folded = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(p.rlike(r"(^|/)\.\.?$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(folded, tail), "/")


def base_parts(base: Column) -> Column:
    """What a reference is resolved against; compute it once per page."""
    return F.struct(
        base.alias("url"),
        scheme(base).alias("scheme"),
        origin(base).alias("root"),
        F.regexp_extract(base, rf"^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)", 1).alias("path"),
        F.regexp_extract(base, rf"^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*/)?", 1).alias("folder"),
        F.regexp_extract(base, r"^[^?#]*(\?[^#]+)", 1).alias("query"),
    )


def resolve_against(href: Column, parts: Column, keep_fragment: bool = False) -> Column:
    """Reference resolution; ``parts`` comes from ``base_parts``."""

    def place(ref: Column) -> Column:
        ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
        ref_tail = F.regexp_extract(ref, r"(?s)^[^?#]*((?:\?[^#]+)?(?:#.*)?)$", 1)
        same_page = F.concat(
            parts.root, parts.path, F.when(ref.rlike(r"^\?[^#]"), F.lit("")).otherwise(parts.query), ref_tail
        )
        joined = F.when(ref.startswith("/"), ref_path).otherwise(
            F.regexp_replace(F.concat(parts.folder, F.lit("/"), ref_path), "/{2,}", "/")
        )
        clean = let(joined, lambda j: F.when(j.rlike(r"(^|/)\.\.?(/|$)"), _fold_dots(j)).otherwise(j))
        rooted = F.concat(parts.root, F.lit("/"), F.regexp_replace(clean, "^/", ""), ref_tail)
        return (
            F.when(ref.rlike(rf"^{_SCHEME}:"), ref)
            .when(ref.startswith("//"), F.concat(parts.scheme, F.lit(":"), ref))
            .when(ref == "", parts.url if keep_fragment else strip_fragment(parts.url))
            .when(ref.rlike(r"^[?#]"), same_page)
            .otherwise(rooted)
        )

    return let(href if keep_fragment else strip_fragment(href), place)


def resolve(href: Column, base: Column, keep_fragment: bool = False) -> Column:
    return let(base_parts(base), lambda parts: resolve_against(href, parts, keep_fragment))


def percent_decoded(text: Column) -> Column:
    """Escapes as the characters they stand for; malformed escapes stay, bytes that are no UTF-8 become U+FFFD."""
    parts = F.regexp_extract_all(text, F.lit("((?:%[0-9A-Fa-f]{2})+|[^%]+|%)"), F.lit(1))
    spelled = F.transform(
        parts,
        lambda t: F.when(t.rlike("^%[0-9A-Fa-f]{2}"), F.make_valid_utf8(F.unhex(F.replace(t, F.lit("%"), F.lit(""))).cast("string"))).otherwise(t),
    )
    return F.when(text.contains("%"), F.array_join(spelled, "")).otherwise(text)


def percent_encoded(text: Column) -> Column:
    """Everything but letters, digits and ``/ - . _ ~`` as escapes of its UTF-8 bytes."""
    coded = F.url_encode(text)
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        coded = F.replace(coded, F.lit(form), F.lit(plain))
    return coded
