"""Findings about a whole site: robots, sitemap, address consistency, certificate, http probe, browser fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditlake.functions import text as X, urls as U
from auditlake.functions.binding import unpack
from auditlake.operators.aggregates import url_consistency
from auditlake.operators.robots import AI_BOTS, declared_sitemaps, group_for_bot, robots_rules, verdict
from auditlake.operators.rules import EXPIRY_DAYS
from auditlake.operators.sitemaps import listed_status, missing_from_sitemap

# Codes that describe robots and sitemap presence rather than a problem of their own.
STRUCTURE_CODES = ["robots_missing", "robots_blocks_everything", "robots_no_sitemap_directive", "sitemap_empty"]


def _finding(when: Column, category: str, severity: str, code: str, message: Column) -> Column:
    return F.when(
        F.coalesce(when, F.lit(False)),
        F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message")),
    )


def certificate_facts(certificates: DataFrame, as_of: Column) -> DataFrame:
    """Issuer, expiry and days left of each certificate; an unreadable date leaves the days unknown."""
    expiry = F.when(F.col("valid"), X.certificate_expiry(F.col("not_after")))
    return certificates.withColumn("expires_at", expiry).select(
        "site", "valid", "error",
        F.when(F.col("valid"), F.when(F.col("organization") != "", F.col("organization")).otherwise(F.col("common_name"))).otherwise(F.lit("")).alias("issuer"),
        "expires_at",
        X.days_until(F.col("expires_at"), as_of).alias("days_left"),
    )


def site_inputs(sites, pages, robots_docs, listed, certificates, probes, signals, as_of) -> DataFrame:
    """One row per site with everything the site rules look at.  All joins are between per-site aggregates."""
    default_group = group_for_bot(robots_rules(robots_docs), F.lit("*")).select("site", verdict(F.col("decision.rules"), F.lit("/")).alias("start_allowed"))
    found = robots_docs.select("site", F.lit(True).alias("robots_found")).distinct()
    declared = declared_sitemaps(robots_docs).groupBy("site").agg(F.count("*").alias("declared"))
    statuses = listed_status(pages, listed)
    sitemap = statuses.groupBy("site").agg(
        F.count("*").alias("listed"),
        F.count_if(U.registrable_domain(F.col("loc")) != U.registrable_domain(F.concat(F.lit("https://"), "site", F.lit("/")))).alias("off_domain"),
        F.count_if(F.col("status") >= 400).alias("broken"),
    )
    missing = missing_from_sitemap(pages, listed).groupBy("site").agg(F.count("*").alias("missing"))
    out = sites
    for part in (
        found, default_group, declared, sitemap, missing, url_consistency(pages),
        certificate_facts(certificates, as_of).select("site", "valid", F.col("error").alias("tls_error"), "days_left"),
        probes.select("site", F.col("final_url").alias("probe_url"), F.col("hop_statuses").alias("probe_hops"), F.col("error").alias("probe_error")),
        signals.select("site", "browser_fallback", "browser_unavailable"),
    ):
        out = out.join(part, "site", "left")
    return out.fillna(0, ["listed", "off_domain", "broken", "missing", "declared"]).fillna(False, ["robots_found"])


def site_issues(inputs: DataFrame) -> DataFrame:
    """Site findings, one row each, in reporting order."""
    no_robots = ~F.col("robots_found")
    listed = F.col("listed") > 0
    has_tls = F.col("valid").isNotNull()
    probed = F.col("probe_url").isNotNull()
    to_https = F.col("probe_url").startswith("https://")
    days = F.col("days_left")
    text = lambda c: F.col(c).cast("string")
    # fixed values: categories, severities, codes and messages
    findings = F.array_compact(
        F.array(
            _finding(no_robots, "sitemap_robots", "info", "robots_missing", F.lit("No se encontró robots.txt (se asume que todo está permitido).")),
            _finding(~no_robots & ~F.coalesce("start_allowed", F.lit(True)), "sitemap_robots", "critical", "robots_blocks_everything",
                     F.lit("robots.txt bloquea el rastreo de la URL semilla para todos los user-agents.")),
            _finding(~no_robots & (F.col("declared") == 0), "sitemap_robots", "warning", "robots_no_sitemap_directive",
                     F.lit("robots.txt no declara ninguna directiva Sitemap:.")),
            _finding(F.col("browser_unavailable"), "rendering", "warning", "render_browser_unavailable",
                     F.lit("No se pudo iniciar el navegador para renderizado JS, se continuó sin él.")),
            _finding(F.col("mixed_www"), "security", "critical", "mixed_www",
                     F.lit("El sitio responde tanto en versión www como sin www sin redirigir a una sola.")),
            _finding(F.col("mixed_scheme"), "security", "critical", "mixed_scheme",
                     F.lit("El sitio responde tanto en HTTP como en HTTPS sin redirigir a una sola versión.")),
            _finding(F.col("mixed_trailing_slash"), "url_conventions", "warning", "mixed_trailing_slash",
                     F.lit("El sitio mezcla URLs con y sin barra final sin una convención consistente.")),
            _finding(~listed, "sitemap_robots", "warning", "sitemap_empty", F.lit("El sitemap no contiene URLs.")),
            _finding(listed & (F.col("off_domain") > 0), "sitemap_robots", "warning", "sitemap_off_domain_urls",
                     F.concat(F.lit("El sitemap incluye "), text("off_domain"), F.lit(" URL(s) de otro dominio."))),
            _finding(listed & (F.col("broken") > 0), "sitemap_robots", "critical", "sitemap_broken_urls",
                     F.concat(F.lit("El sitemap incluye "), text("broken"), F.lit(" URL(s) que devuelven error 4xx/5xx."))),
            _finding(listed & (F.col("missing") > 0), "sitemap_robots", "info", "sitemap_missing_crawled_urls",
                     F.concat(text("missing"), F.lit(" URL(s) rastreadas no aparecen en el sitemap."))),
            _finding(probed & ~to_https, "security", "critical", "http_not_redirected_to_https", F.lit("La versión HTTP no redirige a HTTPS.")),
            _finding(probed & to_https & (F.col("probe_hops") == ""), "security", "warning", "https_no_redirect_detected",
                     F.lit("No se detectó un redirect explícito de HTTP a HTTPS (verificar configuración del servidor).")),
            _finding(probed & to_https & F.exists(F.split("probe_hops", ","), lambda h: (h != "") & ~h.isin("301", "308")), "security", "warning",
                     "http_to_https_not_permanent", F.lit("El redirect de HTTP a HTTPS no usa un código permanente (301/308).")),
            _finding(~probed & (F.col("probe_error") != ""), "security", "warning", "http_check_failed",
                     F.concat(F.lit("No se pudo verificar el redirect HTTP→HTTPS: "), "probe_error")),
            _finding(has_tls & ~F.col("valid") & ~F.coalesce("browser_fallback", F.lit(False)), "security", "critical", "tls_invalid",
                     F.concat(F.lit("Certificado HTTPS inválido o inalcanzable: "), "tls_error")),
            _finding(F.col("valid") & (days < 0), "security", "critical", "tls_expired", F.lit("El certificado HTTPS ya expiró.")),
            _finding(F.col("valid") & (days >= 0) & (days < EXPIRY_DAYS), "security", "warning", "tls_expiring_soon",
                     F.concat(F.lit("El certificado HTTPS expira en "), text("days_left"), F.lit(" día(s)."))),
            _finding(F.col("browser_fallback"), "security", "info", "tls_browser_fallback",
                     F.lit("El servidor exige una versión de TLS que el cliente HTTP directo no soporta (p. ej. sitios configurados "
                           "solo-TLS 1.3); las páginas se descargaron a través del navegador Chromium integrado.")),
        )
    )
    return unpack(inputs.select("site", findings.alias("found")), "found", "i", "issue_seq").select("site", "issue_seq", "i.*")


def site_infrastructure(sites: DataFrame, issues: DataFrame, listed: DataFrame) -> DataFrame:
    """Presence summary per site plus the other findings (site findings are a bounded list)."""
    seen = lambda code: F.max(F.col("code") == code)
    flags = issues.groupBy("site").agg(
        seen("robots_missing").alias("no_robots"), seen("robots_blocks_everything").alias("blocks"),
        seen("robots_no_sitemap_directive").alias("no_directive"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("code").isin(STRUCTURE_CODES), F.col("code")))), ",").alias("other_findings"),
    )
    counts = listed.groupBy("site").agg(F.count("*").alias("sitemap_url_count"))
    no = F.lit(False)
    return sites.join(flags, "site", "left").join(counts, "site", "left").select(
        "site",
        (~F.coalesce("no_robots", no)).alias("robots_found"),
        (~F.coalesce("blocks", no)).alias("robots_allows_crawling"),
        (~F.coalesce("no_directive", no)).alias("robots_declares_sitemap"),
        (F.coalesce("sitemap_url_count", F.lit(0)) > 0).alias("sitemap_found"),
        F.coalesce("sitemap_url_count", F.lit(0)).alias("sitemap_url_count"),
        F.coalesce("other_findings", F.lit("")).alias("other_findings"),
    )


def ai_readiness(pages: DataFrame, access: DataFrame, signals: DataFrame) -> DataFrame:
    """How open a site is to assistants, 0-100 from public signals."""
    bots = access.groupBy("site").agg(F.count_if(~F.col("allowed")).alias("blocked_bots"), F.max("robots_found").alias("robots_found"))
    ok = F.col("status") == 200
    content = pages.groupBy("site").agg(
        F.count_if(ok).alias("pages_ok"),
        F.count_if(ok & (F.size("json_ld_types") > 0)).alias("structured_pages"),
        F.count_if(ok & (F.col("meta_description") != "")).alias("described_pages"),
    )
    joined = content.join(bots, "site").join(signals, "site")
    ratio = lambda c: F.when(F.col("pages_ok") > 0, F.col(c) / F.col("pages_ok")).otherwise(F.lit(0.0))
    points = (
        F.lit(40.0) * (F.lit(1.0) - F.col("blocked_bots") / F.lit(float(len(AI_BOTS))))
        + F.when(F.col("llms_txt"), F.lit(20.0)).otherwise(F.lit(0.0))
        + F.lit(20.0) * ratio("structured_pages")
        + F.lit(10.0) * ratio("described_pages")
        + F.when(F.col("encyclopedia"), F.lit(10.0)).otherwise(F.lit(0.0))
    )
    return joined.select(
        "site", "robots_found", "blocked_bots", "pages_ok", "structured_pages", "described_pages",
        F.bround(F.least(F.lit(100.0), points), 0).cast("long").alias("readiness"),
    )
