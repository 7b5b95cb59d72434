"""The rule catalogue: one declarative list, evaluated as one array expression per page."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from auditlake.functions import text as X, urls as U
from auditlake.functions.binding import unpack
from auditlake.operators.facts import is_indexable

# Severity weights and order, categories in display order.
SEVERITY_WEIGHT = {"critical": 10, "warning": 3, "info": 1}
SEVERITY_ORDER = {"critical": 0, "warning": 1, "info": 2}
CATEGORIES = [
    "response_codes", "titles", "meta", "canonicals", "directives", "links", "sitemap_robots", "security",
    "redirects", "duplicates", "url_conventions", "rendering", "tech",
]
# Limits of the on-page rules.
TITLE_MIN, TITLE_MAX, DESCRIPTION_MIN, DESCRIPTION_MAX, THIN_WORDS, LONG_CHAIN, EXPIRY_DAYS = 15, 60, 50, 160, 150, 2, 14

ISSUE_TYPE = "struct<category:string,severity:string,code:string,message:string>"


def lookup(value: Column, table: dict) -> Column:
    """Value of a small fixed table; NULL for anything else."""
    out = None
    for key, result in table.items():
        out = F.when(value == key, F.lit(result)) if out is None else out.when(value == key, F.lit(result))
    return out


def weight(severity: Column) -> Column:
    return lookup(severity, SEVERITY_WEIGHT)


def order(severity: Column) -> Column:
    return F.coalesce(lookup(severity, SEVERITY_ORDER), F.lit(3))


@dataclass(frozen=True)
class Rule:
    """A finding: ``when`` decides, ``message`` words it.  ``severity`` and ``code`` may be computed."""

    category: str
    severity: str | Callable[[], Column]
    code: str | Callable[[], Column]
    when: Callable[[], Column]
    message: Callable[[], Column]

    def issue(self) -> Column:
        severity = F.lit(self.severity) if isinstance(self.severity, str) else self.severity()
        code = F.lit(self.code) if isinstance(self.code, str) else self.code()
        found = F.struct(
            F.lit(self.category).alias("category"), severity.alias("severity"), code.alias("code"),
            self.message().alias("message"),
        )
        return F.when(F.coalesce(self.when(), F.lit(False)), found)


def say(*parts) -> Callable[[], Column]:
    """Message made of literal text and column expressions (given as SQL in a one-item tuple)."""
    return lambda: F.concat(*[F.expr(p[0]).cast("string") if isinstance(p, tuple) else F.lit(p) for p in parts])


def sql(text: str) -> Callable[[], Column]:
    return lambda: F.expr(text)



_ROBOTS = "lower(concat(meta_robots, ' ', x_robots_tag))"
_CANONICAL_OFF = (
    "status = 200 AND canonical <> '' AND canonical <> url "
    "AND canonical <> CASE WHEN final_url = '' THEN url ELSE final_url END"
)
_HTML_SEEN = "(size(redirect_chain) > 0 OR status = 200)"

# Page rules in reporting order.  Fixed values: categories, severities, codes, messages and limits.
PAGE_RULES = [
    Rule("response_codes", "critical", sql("CASE WHEN error_type = '' THEN 'connection_error' ELSE error_type END"),
         sql("status IS NULL"),
         lambda: F.concat(X.error_label(F.col("error_type")), F.expr("CASE WHEN error = '' THEN '' ELSE concat(' (', error, ')') END"), F.lit("."))),
    Rule("response_codes", "critical", "error_404", sql("status = 404"), say("La página devuelve 404.")),
    Rule("response_codes", "critical", "error_4xx", sql("status >= 400 AND status < 500 AND status <> 404"),
         say("La página devuelve un error del cliente (", ("status",), ").")),
    Rule("response_codes", "critical", "error_5xx", sql("status >= 500"),
         say("La página devuelve un error del servidor (", ("status",), ").")),
    Rule("url_conventions", "warning", "url_uppercase", lambda: U.convention_flags(F.col("url"))["url_uppercase"],
         say("La URL contiene mayúsculas.")),
    Rule("url_conventions", "warning", "url_underscore", lambda: U.convention_flags(F.col("url"))["url_underscore"],
         say("La URL contiene guion bajo (usar guiones medios).")),
    Rule("url_conventions", "warning", "url_multi_slash", lambda: U.convention_flags(F.col("url"))["url_multi_slash"],
         say("La URL contiene barras (/) duplicadas.")),
    Rule("url_conventions", "info", "url_numeric_or_special", lambda: U.convention_flags(F.col("url"))["url_numeric_or_special"],
         say("La URL contiene números o caracteres especiales.")),
    Rule("links", "warning", "broken_image", sql("size(broken_images) > 0"),
         say(("size(broken_images)",), " imagen(es) no cargan: ", ("array_join(slice(broken_images, 1, 3), ', ')",),
             ("CASE WHEN size(broken_images) > 3 THEN concat(' (y ', size(broken_images) - 3, ' más)') ELSE '' END",), ".")),
    Rule("titles", "critical", "title_missing", sql("status = 200 AND title = ''"), say("Falta la etiqueta <title>.")),
    Rule("titles", "warning", "title_too_short", sql(f"status = 200 AND title <> '' AND length(title) < {TITLE_MIN}"),
         say("Title muy corto (", ("length(title)",), " caracteres).")),
    Rule("titles", "warning", "title_too_long", sql(f"status = 200 AND length(title) > {TITLE_MAX}"),
         say("Title muy largo (", ("length(title)",), " caracteres).")),
    Rule("meta", "warning", "meta_description_missing", sql("status = 200 AND meta_description = ''"),
         say("Falta la meta description.")),
    Rule("meta", "info", "meta_description_too_short",
         sql(f"status = 200 AND meta_description <> '' AND length(meta_description) < {DESCRIPTION_MIN}"),
         say("Meta description muy corta (", ("length(meta_description)",), " caracteres).")),
    Rule("meta", "info", "meta_description_too_long", sql(f"status = 200 AND length(meta_description) > {DESCRIPTION_MAX}"),
         say("Meta description muy larga (", ("length(meta_description)",), " caracteres).")),
    Rule("meta", "warning", "h1_missing", sql("status = 200 AND size(h1) = 0"), say("Falta la etiqueta <h1>.")),
    Rule("meta", "info", "h1_multiple", sql("status = 200 AND size(h1) > 1"),
         say("Hay ", ("size(h1)",), " etiquetas <h1> en la página.")),
    Rule("meta", "info", "h2_missing", sql("status = 200 AND size(h2) = 0"),
         say("La página no tiene ningún encabezado <h2>.")),
    Rule("directives", "critical", "noindex", sql(f"status = 200 AND {_ROBOTS} LIKE '%noindex%'"),
         say("La página tiene la directiva noindex.")),
    Rule("directives", "info", "nofollow_page", sql(f"status = 200 AND {_ROBOTS} LIKE '%nofollow%'"),
         say("La página tiene la directiva nofollow a nivel de página.")),
    Rule("canonicals", sql("CASE WHEN is_priority_url THEN 'critical' ELSE 'warning' END"), "canonical_points_elsewhere",
         sql(_CANONICAL_OFF),
         say("El canonical apunta a otra URL (", ("canonical",), "), lo que puede impedir la indexación de esta página.")),
    Rule("meta", "info", "thin_content", sql(f"status = 200 AND word_count < {THIN_WORDS}"),
         say("Contenido posiblemente escaso (", ("word_count",), " palabras).")),
    Rule("meta", "warning", "img_alt_missing", sql("status = 200 AND images_without_alt > 0"),
         say(("images_without_alt",), " imagen(es) sin atributo alt.")),
    Rule("links", "warning", "empty_anchors", sql("status = 200 AND empty_anchors > 0"),
         say(("empty_anchors",), " etiqueta(s) <a> vacías (sin href o sin texto/imagen).")),
    Rule("response_codes", "critical", "soft_404", sql("is_soft_404"),
         say("La página devuelve 200 pero su contenido indica que es una página de error (soft 404).")),
    Rule("redirects", "warning", "temporary_redirect_should_be_permanent",
         sql("exists(redirect_chain, h -> h.status IN (302, 303, 307))"),
         say(("size(filter(redirect_chain, h -> h.status IN (302, 303, 307)))",),
             " redirect(s) usan código temporal (302/303/307) para lo que parece ser un movimiento permanente; considerar 301.")),
    Rule("redirects", "warning", "redirect_chain_too_long", sql(f"size(redirect_chain) > {LONG_CHAIN}"),
         say("Cadena de redirects de ", ("size(redirect_chain)",), " saltos; debería resolverse en un solo salto.")),
    Rule("redirects", "critical", "redirect_loop",
         sql("size(redirect_chain) > size(array_distinct(transform(redirect_chain, h -> h.url)))"),
         say("Se detectó un bucle de redirects (la misma URL aparece más de una vez en la cadena).")),
    Rule("redirects", "warning", "meta_refresh_redirect", sql(f"{_HTML_SEEN} AND meta_refresh <> ''"),
         say("La página usa un redirect por meta-refresh hacia ", ("meta_refresh",), " en vez de un 301 HTTP.")),
    Rule("redirects", "warning", "js_redirect", sql(f"{_HTML_SEEN} AND js_redirect"),
         say("La página parece redirigir mediante JavaScript en vez de un 301 HTTP.")),
    Rule("rendering", "warning", "render_failed", sql("render.error <> ''"),
         say("No se pudo renderizar la página: ", ("render.error",))),
    Rule("rendering", "warning", "render_title_mismatch", sql("render.error = '' AND NOT render.title_match"),
         say("El title en el HTML crudo no coincide con el title renderizado (JS lo modifica).")),
    Rule("rendering", "warning", "render_description_mismatch", sql("render.error = '' AND NOT render.description_match"),
         say("La meta description en el HTML crudo no coincide con la renderizada.")),
    Rule("rendering", "warning", "render_h1_mismatch", sql("render.error = '' AND NOT render.h1_match"),
         say("El H1 en el HTML crudo no coincide con el renderizado.")),
    Rule("rendering", "warning", "mobile_desktop_mismatch", sql("render.error = '' AND NOT render.mobile_match"),
         say("El contenido visible difiere significativamente entre mobile y desktop.")),
    Rule("rendering", "critical", "spa_render_unavailable", sql("coalesce(render_unavailable, '') <> ''"),
         say("El sitio necesita JavaScript para mostrar sus enlaces, pero no se pudo iniciar el navegador de renderizado: ",
             ("render_unavailable",), ".")),
    Rule("directives", "critical", "priority_url_not_indexable", lambda: F.col("is_priority") & ~is_indexable(),
         say("Esta URL fue marcada como importante pero no es indexable (noindex, canonical hacia otra URL, o no responde 200).")),
    Rule("links", "warning", "orphan_page", sql("is_orphan"),
         say("Página encontrada en el sitemap pero sin ningún enlace interno hacia ella.")),
    Rule("sitemap_robots", "info", "not_in_sitemap", lambda: F.col("site_has_sitemap") & is_indexable() & ~F.col("in_sitemap"),
         say("Página indexable que no aparece en el sitemap.xml.")),
    Rule("duplicates", "critical", "duplicate_content", sql("same_content > 1"),
         say("Contenido duplicado con otras ", ("same_content - 1",), " URL(s).")),
    Rule("duplicates", "warning", "duplicate_title", sql("same_title > 1"),
         say("Title duplicado con otras ", ("same_title - 1",), " URL(s).")),
    Rule("duplicates", "info", "duplicate_meta_description", sql("same_meta > 1"),
         say("Meta description duplicada con otras ", ("same_meta - 1",), " URL(s).")),
]

BLOCKED = Rule("sitemap_robots", "info", "blocked_by_robots", sql("is_blocked"),
               say("Esta URL fue descubierta pero no se rastreó por estar bloqueada en robots.txt."))

# Inputs a caller may leave out; a missing one never fires a rule.
DEFAULT_INPUTS = {
    "broken_images": "cast(array() AS array<string>)",
    "is_priority_url": "false",
    "is_priority": "false",
    "is_orphan": "false",
    "is_blocked": "false",
    "in_sitemap": "false",
    "site_has_sitemap": "false",
    "same_content": "1L",
    "same_title": "1L",
    "same_meta": "1L",
    "render": "cast(NULL AS struct<error:string,title_match:boolean,description_match:boolean,h1_match:boolean,mobile_match:boolean>)",
    "render_unavailable": "''",
}


@lru_cache(maxsize=2)
def _issues(application: str) -> Column:
    every = F.array_compact(F.array(*[r.issue() for r in PAGE_RULES]))
    # a denied page has no facts; all else that can be said of it is that no link led to it
    denied = F.array_compact(F.array(BLOCKED.issue(), next(r for r in PAGE_RULES if r.code == "orphan_page").issue()))
    return F.when(F.col("is_blocked"), denied).otherwise(every)


def collect_page_issues(pages: DataFrame, extra_rules: list[Rule] | None = None) -> DataFrame:
    """Adds ``issues``, in reporting order.  ``extra_rules`` is the extension point for users."""
    for name, default in DEFAULT_INPUTS.items():
        if name not in pages.columns:
            pages = pages.withColumn(name, F.expr(default))
    issues = _issues(pages.sparkSession.sparkContext.applicationId)
    if extra_rules:
        issues = F.concat(issues, F.array_compact(F.array(*[r.issue() for r in extra_rules])))
    return pages.withColumn("issues", issues)


def issue_rows(audited: DataFrame) -> DataFrame:
    """One row per finding, with the sequence numbers that keep first-seen order."""
    return unpack(audited.select("page_id", "site", "url", "issues"), "issues", "issue", "issue_seq").select(
        "page_id", "site", "url", "issue_seq", "issue.*"
    )
