"""URL filters: host rules first, then token combinations mined from labels with FP-growth.

A labelled url is a basket of its tokens (host labels, path and query words) and, if it is bad, one more item.  FP-growth
gives the frequent combinations; those that imply the bad item with enough confidence, and better than any part of them,
are the rules.  They are pruned level by level and stay a table.  Rules match by an inverted index: the rarest token of each
rule to the rule; it fires when the url holds all its tokens.

A null url or one without ``://`` has an empty host and path, meets no host rule and holds no tokens, so it is allowed.
Labels may repeat or be null (left out).  Rows that repeat a url agree.  Other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from auditlake.operators.shuffle import stage

BAD = "\x00bad"  # no token holds a control character
LABELLED = 50_000  # labelled urls that are mined, at most about
SUPPORT, CONFIDENCE = 0.002, 0.6
LEAST = 20  # baskets that a combination must be found in, whatever the support
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the path begins with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query's contract.
HOST_RULES = (HostRule("net", "/", "block"), HostRule("example.net", "/en/", "allow"), HostRule("example.com", "/de/", "block"), HostRule("org", "/fr/", "allow"))


def parsed(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    out = df.withColumn("_rest", F.coalesce(rest, F.lit("")))
    out = out.withColumn("host", F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), _UPPER, _LOWER))
    return out.withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)).drop("_rest")


def host_rule(rules: tuple[HostRule, ...] = HOST_RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits ``host`` and ``path``; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def tokens(url: str = "url") -> Column:
    """Distinct words of a url: runs of letters and digits after ``://``, in lower case."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(rest, F.lit(""))), r"[^\p{L}\p{N}]+"), ""))


def _rules(labelled: DataFrame, support: float, confidence: float) -> DataFrame | None:
    """Stored rules (items, confidence, support, rarest) of ``labelled`` (url, bad); a rule no better than a part of it goes."""
    known = labelled.where("url is not null and bad is not null").select("url", F.col("bad").cast("boolean").alias("bad"))
    n = known.count()
    support = max(support, LEAST / min(n, LABELLED)) if n else 2.0
    if support > 1:
        return None
    share = F.lit(min(1_000_000, -(-LABELLED * 1_000_000 // n)))
    known = known.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < share)
    baskets = known.select(F.when(F.col("bad"), F.array_append(tokens(), F.lit(BAD))).otherwise(tokens()).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support).fit(baskets)
    sets = stage(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    # every part of a frequent combination that holds the bad item is itself such a combination: none is missing below
    held = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("bad"))
    scored = held.join(sets, "items").select("items", F.size("items").alias("size"), (F.col("bad") / F.col("freq")).alias("confidence"), "bad")
    scored = stage(scored, "scored")
    top = scored.where(F.col("confidence") >= confidence).agg(F.max("size").alias("top")).first()["top"]
    if top is None:
        return None
    best = stage(scored.where("size = 1").withColumn("best", F.col("confidence")).withColumn("part", F.lit(0.0)), "level")
    levels = [best]
    for size in range(2, top + 1):
        level = scored.where(F.col("size") == size)
        parts = level.select("items", F.explode("items").alias("x")).select("items", F.expr("array_remove(items, x)").alias("less"))
        less = best.select(F.col("items").alias("less"), "best")
        part = parts.join(less, "less").groupBy("items").agg(F.max("best").alias("part"))
        best = stage(level.join(part, "items").withColumn("best", F.greatest("confidence", "part")).select(*best.columns), "level")
        levels.append(best)
    kept = None
    for level in levels:
        good = level.where((F.col("confidence") >= confidence) & (F.col("confidence") > F.col("part"))).select("items", "confidence", "bad")
        kept = good if kept is None else kept.union(good)
    count = baskets.count()
    single = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rare = kept.select("items", F.explode("items").alias("token")).join(single, "token").groupBy("items").agg(F.min_by("token", F.struct("freq", "token")).alias("rarest"))
    return stage(kept.join(rare, "items").select("items", "confidence", (F.col("bad") / count).alias("support"), "rarest"), "rules")


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[tuple[tuple[str, ...], float, float]]:
    """Rules (tokens, confidence, support) of ``labelled`` (url, bad), best first, collected to be looked at."""
    found = _rules(labelled, support, confidence)
    if found is None:
        return []
    ordered = found.orderBy(F.desc("confidence"), F.desc("support"), "items").collect()
    return [(tuple(r["items"]), r["confidence"], r["support"]) for r in ordered]


def judged(pages: DataFrame, labelled: DataFrame, rules: tuple[HostRule, ...] = HOST_RULES) -> DataFrame:
    """``pages`` with host, path, ``rule`` and ``verdict``."""
    found = _rules(labelled, SUPPORT, CONFIDENCE)
    name, verdict = host_rule(rules)
    out = parsed(pages).withColumn("rule", name).withColumn("_said", verdict)
    if found is None:
        return out.withColumn("verdict", F.coalesce("_said", F.lit("allow"))).drop("_said")
    urls = pages.select("url").where("url is not null").distinct().select("url", tokens().alias("_tokens"))
    hits = urls.select("url", "_tokens", F.explode("_tokens").alias("rarest")).join(found.select("rarest", "items"), "rarest")
    hits = hits.where(F.size(F.array_except("items", "_tokens")) == 0)
    bad = hits.select(F.col("url").alias("_url")).distinct().withColumn("_bad", F.lit(True))
    out = out.join(bad, out.url == bad._url, "left").withColumn("verdict", F.coalesce("_said", F.when(F.col("_bad"), "block"), F.lit("allow")))
    return out.drop("_url", "_bad", "_said")
