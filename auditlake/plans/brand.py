"""Brand-visibility queries over answers derived from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import text as X
from auditlake.operators import brand as B
from auditlake.plans import duck as D, inputs as I
from auditlake.plans.registry import query
from auditlake.sources import sinks
from auditlake.sources.tables import table

u = F.col

# A run's parameters: words that occur in the documents, one alias, one word that does not occur.
BRANDS = [
    B.Brand("Thing", "thion.th", ("thtion",), True), B.Brand("attion"), B.Brand("erble", "erble"), B.Brand("ertion"), B.Brand("Ninguna", "ninguna.example"),
]
_TERMS = [(i, b.name, t.lower(), b.domain.lower(), b.is_target) for i, b in enumerate(BRANDS) for t in b.terms()]

D.CTES["terms"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {D.lit(n)}, {D.lit(t)}, {D.lit(d)}, {str(g).lower()})" for i, n, t, d, g in _TERMS) + ") t(brand_no, brand, term, domain, is_target)"
D.CTES["brand_list"] = "SELECT DISTINCT brand_no, brand, is_target FROM terms"
D.CTES["folded_answers"] = f"SELECT resp_id, {D.fold('text')} AS folded FROM responses WHERE error = '' AND text <> ''"
D.CTES["brand_hits"] = r"""
SELECT resp_id, brand_no, brand, min(off) AS off, bool_or(cited) AS cited FROM (
  SELECT a.resp_id, t.brand_no, t.brand, length(regexp_extract(a.folded, '(?s)^(.*?(?:^|[^a-z0-9]))\Q' || t.term || '\E(?:[^a-z0-9]|$)', 1)) AS off,
    regexp_matches(a.folded, '(^|[^a-z0-9])\Q' || t.term || '\E([^a-z0-9]|$)') AS hit, t.domain <> '' AND contains(a.folded, t.domain) AS cited FROM folded_answers a CROSS JOIN terms t)
WHERE hit GROUP BY ALL
"""
D.CTES["mention_rows"] = "SELECT h.resp_id, h.brand_no, h.brand, row_number() OVER (PARTITION BY h.resp_id ORDER BY off, brand_no) AS position, cited AS is_domain_citation FROM brand_hits h"
D.CTES["tones"] = f"""
SELECT resp_id, brand_no, CASE WHEN contains({D.fold('reply')}, 'positivo') THEN 'positivo' WHEN contains({D.fold('reply')}, 'neutro') THEN 'neutro' WHEN contains({D.fold('reply')}, 'negativo') THEN 'negativo'
  WHEN contains({D.fold('reply')}, 'con_reservas') THEN 'con_reservas' ELSE 'neutro' END AS framing FROM brand_replies
"""


def _stats_sql(dims: list[str]) -> str:
    group = "".join(f"r.{d}, " for d in dims)
    tones = ", ".join(f"CASE WHEN count(t.framing) > 0 THEN count_if(t.framing = '{f}') / count(t.framing) ELSE 0.0 END::double AS framing_{f}" for f in X.FRAMINGS)
    return f"""
SELECT {group} b.brand_no::bigint AS brand_no, b.brand, b.is_target, count(*) AS responses, count(m.brand) / count(*) AS mention_rate, avg(m.position) AS avg_position,
  CASE WHEN sum(n.n) > 0 THEN count(m.brand) / sum(n.n)::bigint ELSE 0.0 END::double AS share_of_voice,
  CASE WHEN count_if(r.web_search) > 0 THEN coalesce(count_if(r.web_search AND m.is_domain_citation), 0) / count_if(r.web_search) END::double AS domain_citation_rate, {tones}
FROM responses r CROSS JOIN brand_list b LEFT JOIN mention_rows m ON m.resp_id = r.resp_id AND m.brand = b.brand LEFT JOIN (SELECT resp_id, count(*) AS n FROM mention_rows GROUP BY resp_id) n ON n.resp_id = r.resp_id
LEFT JOIN tones t ON t.resp_id = r.resp_id AND t.brand_no = b.brand_no AND m.brand IS NOT NULL GROUP BY {group} b.brand_no, b.brand, b.is_target"""


_STAT_COLUMNS = ["brand_no", "brand", "is_target", "responses", "mention_rate", "avg_position", "share_of_voice", "domain_citation_rate"] + [f"framing_{f}" for f in X.FRAMINGS]


def _responses(spark, sf):
    return table(spark, sf, "responses")


def _analyses(spark, sf):
    """Answers with mentions and the tone of each brand that was asked about."""
    name = F.get(F.array(*[F.lit(b.name) for b in BRANDS]), u("brand_no").cast("int"))
    tones = B.tones_by_brand(table(spark, sf, "brand_replies").withColumn("brand", name))
    return B.with_mentions(_responses(spark, sf), BRANDS).drop("text").join(tones, "resp_id", "left")


@query("brand_mentions", "SELECT m.resp_id, r.provider, r.intent, m.brand, m.position, m.is_domain_citation FROM mention_rows m JOIN responses r ON r.resp_id = m.resp_id")
def brand_mentions(spark, sf):
    return B.brand_mentions(B.with_mentions(_responses(spark, sf), BRANDS))


@query("brand_stats", _stats_sql([]))
def brand_stats(spark, sf):
    return B.brand_stats(_analyses(spark, sf), BRANDS, [[]]).select(*_STAT_COLUMNS)


_SETS = [["provider", "intent"], ["provider"], ["intent"], []]


@query("brand_stats_sets", " UNION ALL BY NAME ".join(
    f"SELECT '{'+'.join(s) or 'all'}' AS grain, * FROM ({_stats_sql(s)})" + ("" if s != [] else "") for s in _SETS))
def brand_stats_sets(spark, sf):
    """By provider and intent, by provider, by intent and overall, in one pass."""
    stats = B.brand_stats(_analyses(spark, sf), BRANDS, _SETS)
    intent, provider = u("intent").isNotNull(), u("provider").isNotNull()
    grain = F.when(intent & provider, F.lit("provider+intent")).when(provider, F.lit("provider")).when(intent, F.lit("intent")).otherwise(F.lit("all"))
    return stats.select(grain.alias("grain"), "provider", "intent", *_STAT_COLUMNS)


@query("brand_stats_export", f"""
SELECT {D.labels('provider', B.PROVIDER_LABELS)} AS modelo, {D.labels('intent', B.INTENT_LABELS)} AS tipo_intent, brand AS marca, CASE WHEN is_target THEN 'sí' ELSE 'no' END AS es_objetivo, responses AS respuestas, printf('%.3f', mention_rate) AS tasa_mencion,
  CASE WHEN avg_position IS NULL THEN '' ELSE printf('%.2f', avg_position) END AS posicion_promedio, printf('%.3f', share_of_voice) AS share_of_voice, CASE WHEN domain_citation_rate IS NULL THEN '' ELSE printf('%.3f', domain_citation_rate) END AS tasa_cita_dominio,
  {", ".join(f"printf('%.3f', framing_{f}) AS framing_{f}" for f in X.FRAMINGS)} FROM ({_stats_sql(["provider", "intent"])})""")
def brand_stats_export(spark, sf):
    return sinks.brand_stats_sheet(B.brand_stats(_analyses(spark, sf), BRANDS, [["provider", "intent"]]))


@query("brand_rank", f"SELECT brand, mention_rate, row_number() OVER (ORDER BY mention_rate DESC, brand_no) AS place, round_even(mention_rate / CASE WHEN max(mention_rate) OVER () = 0 THEN 1 ELSE max(mention_rate) OVER () END * 100.0::double, 0)::bigint AS bar FROM ({_stats_sql([])})")
def brand_rank(spark, sf):
    """Display order of a run's brands (a parameter-sized list) with bars scaled to the best."""
    from pyspark.sql import Window as W

    stats = B.brand_stats(_analyses(spark, sf), BRANDS, [[]])
    best = F.max("mention_rate").over(W.partitionBy("gid"))
    place = F.row_number().over(W.partitionBy("gid").orderBy(F.desc("mention_rate"), "brand_no"))
    bar = F.bround(u("mention_rate") / F.when(best == 0, F.lit(1.0)).otherwise(best) * F.lit(100.0), 0).cast("long")
    return stats.select("brand", "mention_rate", place.alias("place"), bar.alias("bar"))


@query("brand_run_rows", """
SELECT r.resp_id, r.provider, r.intent, r.query, r.repetition, r.web_search, length(r.text) AS n_chars, r.error, coalesce((SELECT string_agg(m.brand || ':' || m.position, ',' ORDER BY m.position) FROM mention_rows m WHERE m.resp_id = r.resp_id), '') AS mentions FROM responses r""")
def brand_run_rows(spark, sf):
    """A run saved as a version and read back: raw answers next to the derived mentions."""
    shown = F.array_join(F.transform("mentions", lambda m: F.concat(m.brand, F.lit(":"), m.position.cast("string"))), ",")
    runs = I.versioned(spark, "brand-runs")
    sinks.save_brand_run(B.with_mentions(_responses(spark, sf), BRANDS), runs, "Thing", 1706745600)
    return runs.read().select(
        "resp_id", "provider", "intent", "query", "repetition", "web_search", F.length("text").alias("n_chars"), "error", shown.alias("mentions"))


@query("brand_terms", f"""
SELECT site, array_to_string([t FOR t IN [split_part(d, '.', 1), d] IF length(t) >= 3], ',') AS terms FROM (SELECT site, {D.domain("'https://' || site || '/'")} AS d FROM site_list)""")
def brand_terms(spark, sf):
    sites = table(spark, sf, "site_list")
    return sites.select("site", F.array_join(B.domain_terms(F.concat(F.lit("https://"), "site", F.lit("/"))), ",").alias("terms"))


DOMAIN = "https://www.thing.org/"
_MENTIONED = r"regexp_matches(" + D.fold("text") + r", '(^|[^a-z0-9])(thing|thing\.org)([^a-z0-9]|$)')"


def _answers(spark, sf):
    terms = B.domain_terms(F.lit(DOMAIN))
    hit = (u("error") == "") & B.domain_mentioned(u("text"), terms)
    return table(spark, sf, "responses").withColumn("mentioned", hit)


@query("domain_mentions", f"SELECT resp_id, provider, error = '' AND {_MENTIONED} AS mentioned FROM responses")
def domain_mentions(spark, sf):
    return _answers(spark, sf).select("resp_id", "provider", "mentioned")


@query("answer_verdicts", f"""
SELECT resp_id, {D.labels('provider', B.PROVIDER_LABELS)} AS provider, query, CASE WHEN error <> '' THEN 'Error' WHEN {_MENTIONED} THEN 'Sí ✓' ELSE 'No' END AS verdict, CASE WHEN error <> '' THEN error ELSE text END AS detail FROM responses""")
def answer_verdicts(spark, sf):
    return B.answer_verdicts(_answers(spark, sf))


@query("mention_rate", f"SELECT provider, count(*) AS answers, avg(({_MENTIONED})::int) AS rate, CASE WHEN avg(({_MENTIONED})::int) >= 0.5 THEN 'good' WHEN avg(({_MENTIONED})::int) > 0 THEN 'warning' ELSE 'critical' END AS band FROM responses WHERE error = '' GROUP BY provider")
def mention_rate(spark, sf):
    return B.mention_rate(_answers(spark, sf)).withColumn("band", X.rate_band(u("rate")))


@query("battery_plan", "SELECT count(DISTINCT provider) AS providers, count(DISTINCT query) AS queries, count(DISTINCT repetition) AS repetitions, count(DISTINCT provider) * count(DISTINCT query) * count(DISTINCT repetition) AS calls FROM responses")
def battery_plan(spark, sf):
    """Size of the battery a set of answers came from: providers times queries times repetitions."""
    sizes = table(spark, sf, "responses").agg(
        F.count_distinct("provider").alias("providers"), F.count_distinct("query").alias("queries"), F.count_distinct("repetition").alias("repetitions"))
    return sizes.withColumn("calls", u("providers") * u("queries") * u("repetitions"))


_INTENTS = list(B.INTENT_LABELS)
D.CTES["parsed_words"] = """
SELECT doc_id, lang, w1, trim(upper(w1)) AS w2 FROM (SELECT doc_id, coalesce(lang, '') AS lang, regexp_replace(coalesce(text, ''), '[^a-zA-Z]+', ' ', 'g') AS w1 FROM documents) WHERE doc_id % 3 = 0 OR doc_id % 7 <> 1
"""


@query("battery_parse", """
SELECT doc_id, intent, pos, text FROM (
  SELECT doc_id, 'comparativa' AS intent, generate_subscripts(c, 1) - 1 AS pos, trim(unnest(c)) AS text FROM (SELECT doc_id, [' ' || w1 || ' ', '', w2, 'tercera'] AS c FROM parsed_words)
  UNION ALL SELECT doc_id, 'transaccional', 0, lang FROM parsed_words) WHERE text <> ''""")
def battery_parse(spark, sf):
    """A reply whose braces do not close properly gives nothing."""
    return B.parse_battery(table(spark, sf, "battery_replies"), _INTENTS, 4).select("doc_id", "intent", "pos", "text")


