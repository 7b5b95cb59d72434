"""Robots files: parsing, permissions and site findings.

Paths of rules and addresses are compared in one form: decoded, then encoded again.  Rules are found by the first ``HEAD``
characters of an address; only rules shorter than that travel with every page of a site.  Pages are never multiplied by rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from auditlake.functions import urls as U
from auditlake.operators.shuffle import salted_join, stage

# Crawlers of assistants, in display order.
AI_BOTS = [
    ("GPTBot", "OpenAI (entrenamiento de ChatGPT)"),
    ("ChatGPT-User", "OpenAI (navegación en vivo de ChatGPT)"),
    ("OAI-SearchBot", "OpenAI (búsqueda)"),
    ("ClaudeBot", "Anthropic (Claude)"),
    ("anthropic-ai", "Anthropic (Claude, legado)"),
    ("Google-Extended", "Google (Gemini / AI Overviews)"),
    ("PerplexityBot", "Perplexity"),
    ("CCBot", "Common Crawl (fuente de entrenamiento de muchos LLMs)"),
    ("Applebot-Extended", "Apple Intelligence"),
    ("Bytespider", "ByteDance / TikTok"),
    ("Amazonbot", "Amazon"),
]


def robots_lines(docs: DataFrame) -> DataFrame:
    """Directive lines of every file: site, line number, directive, value."""
    lines = docs.select("site", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line_no", "raw"))
    clean = F.trim(F.regexp_replace("raw", "#.*$", ""))
    return lines.select(
        "site",
        "line_no",
        F.when(F.col("raw") == "", F.lit("blank"))
        .otherwise(F.lower(F.trim(F.regexp_extract(clean, "^([^:]*):", 1))))
        .alias("directive"),
        F.trim(F.regexp_extract(clean, "^[^:]*:(.*)$", 1)).alias("value"),
    )


def robots_rules(docs: DataFrame) -> DataFrame:
    """Rules with their group and agents: one row per (group, agent, rule).

    A group starts at a user-agent line that does not follow another one; a blank line ends it; rules with no
    agent before them in their block are ignored.
    """
    known = robots_lines(docs).where(
        F.col("directive").isin("blank", "user-agent", "allow", "disallow", "crawl-delay", "request-rate")
    )
    in_file = W.partitionBy("site").orderBy("line_no")
    starts = (F.col("directive") == "user-agent") & (F.coalesce(F.lag("directive").over(in_file), F.lit("blank")) != "user-agent")
    grouped = (
        known.withColumn("starts", starts.cast("int"))
        .withColumn("group_no", F.sum("starts").over(in_file))
        .withColumn("last_agent", F.max(F.when(F.col("directive") == "user-agent", F.col("line_no"))).over(in_file))
        .withColumn("last_blank", F.max(F.when(F.col("directive") == "blank", F.col("line_no"))).over(in_file))
        .where((F.col("directive") != "blank") & (F.col("last_agent") > F.coalesce("last_blank", F.lit(-1))))
    )
    agents = grouped.where("directive = 'user-agent'").select("site", "group_no", F.col("line_no").alias("agent_no"), F.col("value").alias("agent"))
    rules = grouped.where("directive <> 'user-agent'").select("site", "group_no", F.col("line_no").alias("rule_no"), "directive", "value")
    return agents.join(rules, ["site", "group_no"])


def path_rules(rules: DataFrame) -> DataFrame:
    allow = (F.col("directive") == "allow") | (F.col("value") == "")
    return rules.where(F.col("directive").isin("allow", "disallow")).select(
        "site", "group_no", "agent", "rule_no", allow.alias("allow"), F.col("value").alias("path")
    )


def group_for_bot(rules: DataFrame, bot: Column) -> DataFrame:
    """The one group that decides for ``bot``: the first whose agent is part of its name, else the first ``*`` group.

    Returns site, decision: (group_no, delay, rules in file order).
    """
    name = F.lower(F.substring_index(bot, "/", 1))
    # groups that list "*" only ever act as the default group
    groups = rules.groupBy("site", "group_no").agg(
        F.max(F.col("agent") == "*").alias("is_default"),
        F.max(name.contains(F.lower("agent"))).alias("names_bot"),
        F.max(F.when((F.col("directive") == "crawl-delay") & F.col("value").rlike("^[0-9]+$"), F.struct("rule_no", F.col("value").cast("double").alias("delay")))).getField("delay").alias("delay"),
        F.array_distinct(
            F.sort_array(
                F.collect_list(
                    F.when(
                        F.col("directive").isin("allow", "disallow"),
                        F.struct("rule_no", ((F.col("directive") == "allow") | (F.col("value") == "")).alias("allow"), rule_path(F.col("value")).alias("path")),
                    )
                )
            )
        ).alias("rules"),
    )
    usable = groups.where("is_default OR names_bot")
    return usable.groupBy("site").agg(F.min_by(F.struct("group_no", "delay", "rules"), F.struct("is_default", "group_no")).alias("decision"))


def _without_empty_parts(address: Column) -> Column:
    """Without a ``;``, ``?`` or ``#`` that nothing follows."""
    for empty in (r"(?s)^((?:[^?#]*/)?[^/?#;]*);(?=$|[?#])", r"(?s)^([^?#]*)\?(?=$|#)", r"(?s)^([^#]*)#$"):
        address = F.regexp_replace(address, empty, "$1")
    return address


def rule_path(value: Column) -> Column:
    """Path of a rule in the form that is compared."""
    return U.percent_encoded(_without_empty_parts(U.percent_decoded(value)))


def robots_path(url: Column) -> Column:
    """What follows the host of an address, in the form that is compared."""
    tail = F.regexp_replace(U.percent_decoded(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?", "")
    full = U.percent_encoded(_without_empty_parts(tail))
    return F.when(full == "", F.lit("/")).otherwise(full)


def verdict(decision_rules: Column, path: Column) -> Column:
    """First rule whose path is a prefix decides; nothing matching means allowed."""
    hits = F.filter(decision_rules, lambda r: path.startswith(r.path))
    return F.coalesce(F.get(hits, F.lit(0)).allow, F.lit(True))


HEAD = 8


def robots_allowed(pages: DataFrame, docs: DataFrame, user_agent: str) -> DataFrame:
    """Adds ``is_allowed`` for one crawler; a site without a file allows everything."""
    decisions = group_for_bot(robots_rules(docs), F.lit(user_agent)).select("site", F.col("decision.rules").alias("_rules"))
    short = decisions.select("site", F.filter("_rules", lambda r: F.length(r.path) < HEAD).alias("_short"))
    split = decisions.select("site", F.explode(F.filter("_rules", lambda r: F.length(r.path) >= HEAD)).alias("_rule"))
    long = split.groupBy("site", F.substring("_rule.path", 1, HEAD).alias("_head")).agg(F.sort_array(F.collect_list("_rule")).alias("_long"))
    keyed = pages.withColumn("_path", robots_path(F.col("url"))).withColumn("_head", F.substring("_path", 1, HEAD))
    keyed = stage(keyed, "robots")  # read by the join and by both counts of heavy keys
    joined = salted_join(keyed, short, ["site"], F.col("page_id"))
    joined = salted_join(joined, long, ["site", "_head"], F.col("page_id"), counted=keyed)
    none = F.array().cast("array<struct<rule_no:int,allow:boolean,path:string>>")
    candidates = F.sort_array(F.concat(F.coalesce("_short", none), F.coalesce("_long", none)))
    return joined.withColumn("is_allowed", verdict(candidates, F.col("_path"))).drop("_short", "_long", "_path", "_head")


def crawl_delays(docs: DataFrame, user_agent: str) -> DataFrame:
    return group_for_bot(robots_rules(docs), F.lit(user_agent)).select("site", F.col("decision.delay").alias("crawl_delay")).where(
        "crawl_delay IS NOT NULL"
    )


def bot_access(sites: DataFrame, docs: DataFrame) -> DataFrame:
    """May each assistant crawler fetch the site's start page?  Eleven rows per site, none shuffled twice."""
    rules = robots_rules(docs)
    found = docs.select("site", F.lit(True).alias("robots_found")).distinct()
    out = sites.join(found, "site", "left")
    groups = rules.groupBy("site", "group_no").agg(
        F.collect_set(F.lower("agent")).alias("agents"),
        F.array_distinct(F.sort_array(F.collect_list(F.when(
            F.col("directive").isin("allow", "disallow"),
            F.struct("rule_no", ((F.col("directive") == "allow") | (F.col("value") == "")).alias("allow"), rule_path(F.col("value")).alias("path")))))).alias("rules"),
    )
    files = groups.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("group_no", "agents", "rules"))).alias("groups"))
    bots = F.array(*[F.struct(F.lit(i).alias("bot_no"), F.lit(b).alias("bot"), F.lit(d).alias("description")) for i, (b, d) in enumerate(AI_BOTS)])
    expanded = out.join(files, "site", "left").select("site", F.coalesce("robots_found", F.lit(False)).alias("robots_found"), "groups", F.explode(bots).alias("b"))
    named = F.filter("groups", lambda g: ~F.array_contains(g.agents, "*") & F.exists(g.agents, lambda a: F.lower(F.col("b.bot")).contains(a)))
    default = F.filter("groups", lambda g: F.array_contains(g.agents, "*"))
    chosen = F.coalesce(F.get(named, F.lit(0)), F.get(default, F.lit(0)))
    return expanded.withColumn("chosen", chosen).select(
        "site", "robots_found", "b.bot_no", "b.bot", "b.description", verdict(F.col("chosen.rules"), F.lit("/")).alias("allowed")
    )


def declared_sitemaps(docs: DataFrame) -> DataFrame:
    """``Sitemap:`` lines; they count wherever they stand in the file (a trailing comment is kept as written)."""
    lines = docs.select("site", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line_no", "raw"))
    stripped = F.trim("raw")
    return lines.where(F.lower(stripped).startswith("sitemap:")).select(
        "site", "line_no", F.trim(F.regexp_extract(stripped, "^[^:]*:(.*)$", 1)).alias("sitemap_url")
    )
