"""Site-level aggregates and rankings over audited pages (``issues`` array) or issue rows.

All of them are partial aggregates by site, so a site holding most pages is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from auditlake.functions.binding import unpack
from auditlake.operators.rules import CATEGORIES, SEVERITY_WEIGHT, order, weight

PRIORITY_MULTIPLIER = 1.6  # fixed value


def penalty(issues: str = "issues") -> Column:
    """Severity-weighted sum over a page's findings."""
    return F.aggregate(issues, F.lit(0), lambda acc, i: acc + weight(i.severity))


def has_code(code: str) -> Column:
    return F.exists("issues", lambda i: i.code == code)


def in_category(category: str) -> Column:
    return F.exists("issues", lambda i: i.category == category)


def page_states(pages: DataFrame) -> DataFrame:
    """Sums over a site's audited pages; states of disjoint sets of pages add up."""
    crawled, blocked = F.col("status").isNotNull(), has_code("blocked_by_robots")
    factor = F.when(F.col("is_priority"), F.lit(round(PRIORITY_MULTIPLIER * 10))).otherwise(F.lit(10))  # tenths, so that the sum is exact
    failed = F.col("status").isNull() | (F.col("status") >= 400)
    return pages.groupBy("site").agg(
        F.coalesce(F.sum(F.when(crawled, penalty() * factor)), F.lit(0)).cast("long").alias("tenths"),
        F.count_if(crawled).alias("crawled"),
        F.count("*").alias("total_pages"),
        F.count_if(blocked).alias("blocked_by_robots"),
        F.count_if(~blocked & failed).alias("error_pages"),
        F.count_if(~blocked & ~failed).alias("ok_pages"),
        F.count_if(has_code("duplicate_content")).alias("duplicate_pages"),
        F.count_if("is_orphan").alias("orphan_pages"),
        F.count_if(F.col("status") == 200).alias("answered_200"),
        F.sum("fetch_ms").alias("fetch_ms"),
    )


def merged_page_states(states: DataFrame) -> DataFrame:
    return states.groupBy("site").agg(*[F.sum(c).alias(c) for c in states.columns if c != "site"])


def code_states(pages: DataFrame) -> DataFrame:
    """Per site, code, category and severity: findings, pages whose first finding of the code it is, and the first of all.

    A page's findings are in one row, so only partial counts are shuffled.
    """
    codes = F.transform("issues", lambda i: i.code)
    rows = unpack(pages.select("page_id", "site", "issues", codes.alias("codes")), "issues", "i", "issue_seq")
    opens = F.array_position("codes", F.col("i.code")) == F.col("issue_seq") + 1
    return rows.groupBy("site", F.col("i.code").alias("code"), F.col("i.category").alias("category"), F.col("i.severity").alias("severity")).agg(
        F.count("*").alias("findings"), F.count_if(opens).alias("pages"), F.min(F.when(opens, F.struct("page_id", "issue_seq"))).alias("first")
    )


def merged_code_states(states: DataFrame) -> DataFrame:
    sums = [F.sum("findings").alias("findings"), F.sum("pages").alias("pages"), F.min("first").alias("first")]
    return states.groupBy("site", "code", "category", "severity").agg(*sums)


def health_score(states: DataFrame) -> DataFrame:
    """0-100 per site from ``page_states``: weighted penalties per page with a response, heavier for priority pages."""
    raw = F.bround(F.lit(100.0) - F.col("tenths") * F.lit(6.0) / (F.col("crawled") * F.lit(10.0)), 0)
    score = F.when(F.col("crawled") == 0, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))
    return states.select("site", "crawled", score.cast("long").alias("score"))


def category_breakdown(states: DataFrame) -> DataFrame:
    """From ``code_states``: findings per site and category by severity, with the category's place in the site's ranking."""
    counts = states.groupBy("site", "category").agg(
        *[F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("findings"))), F.lit(0)).alias(s) for s in SEVERITY_WEIGHT], F.sum("findings").alias("total")
    )
    position = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    rank = W.partitionBy("site").orderBy(F.desc("total"), position)
    return counts.withColumn("rank", F.row_number().over(rank))


def crawl_budget(states: DataFrame) -> DataFrame:
    """From ``page_states``."""
    return states.select("site", "total_pages", "blocked_by_robots", "error_pages", "ok_pages", "duplicate_pages", "orphan_pages")


def ok_share(states: DataFrame) -> DataFrame:
    """From ``page_states``: share of pages that answered without error in whole percent (half to even), and seconds spent fetching."""
    share = F.when(F.col("total_pages") > 0, F.bround(F.lit(100.0) * F.col("ok_pages") / F.col("total_pages"), 0)).otherwise(F.lit(0.0))
    return states.select("site", "total_pages", "ok_pages", share.cast("long").alias("ok_percent"), (F.col("fetch_ms") / 1000).alias("fetch_seconds"))


def opportunities(states: DataFrame) -> DataFrame:
    """From ``code_states``, one row per site and code: pages affected, severity as first seen, and its rank by weight times reach."""
    first = F.min(F.when(F.col("first").isNotNull(), F.struct("first.page_id", "first.issue_seq", "category", "severity")))
    per_code = states.groupBy("site", "code").agg(first.alias("first"), F.sum("pages").alias("affected_pages"))
    scored = per_code.select(
        "site", "code", "first.category", "first.severity", "affected_pages",
        (weight(F.col("first.severity")) * F.col("affected_pages")).alias("score"), "first",
    )
    rank = W.partitionBy("site").orderBy(F.desc("score"), F.col("first.page_id"), F.col("first.issue_seq"))
    return scored.withColumn("rank", F.row_number().over(rank)).drop("first")


def _count_of(category: str, severity: str) -> Column:
    return F.size(F.filter("issues", lambda i: (i.category == category) & (i.severity == severity)))


def sidebar_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("site").agg(
        F.count("*").alias("all_pages"),
        F.count_if(F.size("issues") > 0).alias("with_issues"),
        F.count_if("is_orphan").alias("orphans"),
        F.count_if(in_category("duplicates")).alias("duplicates"),
        *[
            F.sum(_count_of(c, s)).alias(f"{c}_{s}")
            for c in CATEGORIES
            for s in SEVERITY_WEIGHT
        ],
    )


def error_pages(pages: DataFrame) -> DataFrame:
    """Pages that failed, robots-blocked ones left out, with the label shown for each."""
    label = (
        F.when(F.col("error") != "", F.col("error"))
        .when(F.col("status").isNull(), F.lit("Sin respuesta"))
        .otherwise(F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    )
    failed = pages.where(~has_code("blocked_by_robots") & (F.col("status").isNull() | (F.col("status") >= 400)))
    return failed.select("page_id", "site", "url", "status", label.alias("label")).orderBy(F.col("status").asc_nulls_last(), "page_id")


def top_offenders(pages: DataFrame, limit: int = 5) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("site").orderBy(F.desc("penalty"), "page_id"))
    scored = pages.where(F.size("issues") > 0).select("page_id", "site", "url", penalty().alias("penalty"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)


def worst_severity() -> Column:
    """0 critical, 1 warning, 2 info, 3 none: sorts the grid."""
    return F.coalesce(F.array_min(F.transform("issues", lambda i: order(i.severity))), F.lit(3))


def max_severity() -> Column:
    labels = {0: "Crítico", 1: "Advertencia", 2: "Info"}
    worst = worst_severity()
    out = F.when(worst == 3, F.lit("Sin issues"))
    for level, text in labels.items():
        out = out.when(worst == level, F.lit(text))
    return out


def url_consistency(pages: DataFrame) -> DataFrame:
    """Per site: mixed www, scheme or trailing-slash use among addresses that answered."""
    from auditlake.functions import urls as U

    address = F.when(F.col("final_url") == "", F.col("url")).otherwise(F.col("final_url"))
    seen = pages.where("status IS NOT NULL").select("site", address.alias("u"))
    p = U.path(F.col("u"))
    inner = ~p.isin("", "/")
    flags = seen.groupBy("site").agg(
        F.count("*").alias("addresses"),
        F.max(U.is_www(F.col("u"))).alias("any_www"), F.min(U.is_www(F.col("u"))).alias("all_www"),
        F.min(U.scheme(F.col("u"))).alias("low_scheme"), F.max(U.scheme(F.col("u"))).alias("high_scheme"),
        F.count_if(inner & p.endswith("/")).alias("with_slash"), F.count_if(inner & ~p.endswith("/")).alias("without_slash"),
    )
    return flags.select(
        "site", "addresses",
        (F.col("any_www") != F.col("all_www")).alias("mixed_www"),
        (F.col("low_scheme") != F.col("high_scheme")).alias("mixed_scheme"),
        "with_slash", "without_slash",
        ((F.col("with_slash") > 0) & (F.col("without_slash") > 0)).alias("mixed_trailing_slash"),
    )


def category_share(states: DataFrame) -> DataFrame:
    """From ``code_states``: share of each category in its site's findings, in whole percent (half to even)."""
    totals = states.groupBy("site", "category").agg(F.sum("findings").alias("total"))
    share = F.bround(F.lit(100.0) * F.col("total") / F.sum("total").over(W.partitionBy("site")), 0).cast("long")
    return totals.withColumn("percent", share)


def truncated(rows: DataFrame, keys: list[str], order_by: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group plus, on each, how many rows the group has beyond them.

    The listing is a top-k (limited before the shuffle) and the overflow a partial count, so no group is sorted
    or gathered whole.
    """
    shown = rows.withColumn("row_no", F.row_number().over(W.partitionBy(*keys).orderBy(*order_by))).where(F.col("row_no") <= limit)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("group_rows"))
    return shown.join(sizes, keys).withColumn("overflow", F.greatest(F.col("group_rows") - limit, F.lit(0)))


def next_steps(opps: DataFrame, breakdown: DataFrame, budget: DataFrame, advice: DataFrame) -> DataFrame:
    """Closing steps per site; the first three only when there is something to say."""
    worst = (
        opps.where("severity = 'critical'").groupBy("site")
        .agg(F.min_by(F.struct("code", "affected_pages"), "rank").alias("worst"))
        .select("site", "worst.code", "worst.affected_pages")
        .join(F.broadcast(advice.select("code", "title")), "code", "left")
    )
    busiest = breakdown.where("rank = 1").select("site", F.initcap(F.replace("category", F.lit("_"), F.lit(" "))).alias("busiest"))
    joined = budget.select("site", "error_pages").join(worst, "site", "left").join(busiest, "site", "left")
    # fixed values: the sentences
    steps = F.array_compact(
        F.array(
            F.when(F.col("code").isNotNull(), F.concat(F.lit("Priorizar: "), F.lower("title"), F.lit(" ("), F.col("affected_pages").cast("string"), F.lit(" páginas afectadas)."))),
            F.when(F.col("busiest").isNotNull(), F.concat(F.lit('La categoría con más hallazgos es "'), "busiest", F.lit('" — enfocar el primer sprint de correcciones ahí.'))),
            F.when(F.col("error_pages") > 0, F.concat(F.lit("Resolver las "), F.col("error_pages").cast("string"), F.lit(" páginas con error para recuperar presupuesto de rastreo."))),
            F.lit("Reevaluar el sitio después de aplicar las correcciones para medir el impacto."),
            F.lit("Programar auditorías periódicas para detectar regresiones a tiempo."),
        )
    )
    return joined.select("site", F.posexplode(steps).alias("pos", "step")).select("site", (F.col("pos") + 1).alias("step_no"), "step")
