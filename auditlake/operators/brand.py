"""Brand visibility over sampled assistant answers.

The brands of a run are a handful of parameters, so mentions are found inside each answer row: no cross join,
no shuffle, no per-answer sort beyond a short array.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from auditlake.functions import text as X, urls as U
from auditlake.functions.binding import let, unpack

# Display names.
PROVIDER_LABELS = {
    "openai": "ChatGPT (OpenAI)", "anthropic": "Claude (Anthropic)", "gemini": "Gemini (Google)",
    "deepseek": "DeepSeek", "perplexity": "Perplexity",
}
INTENT_LABELS = {
    "recomendacion_abierta": "Recomendación abierta", "recomendacion_caso_de_uso": "Recomendación con caso de uso",
    "comparativa": "Comparativa", "transaccional": "Transaccional", "informacional": "Informacional",
}
MAX_QUESTIONS = 4


@dataclass(frozen=True)
class Brand:
    name: str
    domain: str = ""
    aliases: tuple[str, ...] = field(default=())
    is_target: bool = False

    def terms(self) -> list[str]:
        return [t for t in (self.name, *self.aliases, self.domain) if t.strip()]


def _brand_hit(folded: Column, brand: Brand, number: int) -> Column:
    offsets = F.array(*[X.mention_offset(folded, X.fold(F.lit(t))) for t in brand.terms()])
    first = F.array_min(F.filter(offsets, lambda o: o > 0))
    cited = folded.contains(X.fold(F.lit(brand.domain))) if brand.domain else F.lit(False)
    return F.struct(first.alias("start"), F.lit(number).alias("brand_no"), F.lit(brand.name).alias("brand"), cited.alias("is_domain_citation"))


def with_mentions(responses: DataFrame, brands: list[Brand]) -> DataFrame:
    """Adds ``mentions``: brands in order of first whole-word appearance (failed or empty answers have none)."""

    def hits(folded: Column) -> Column:
        found = F.filter(F.array(*[_brand_hit(folded, b, i) for i, b in enumerate(brands)]), lambda h: h.start.isNotNull())
        return F.transform(
            F.array_sort(found),
            lambda h, i: F.struct(h.brand.alias("brand"), (i + 1).alias("position"), h.is_domain_citation.alias("is_domain_citation")),
        )

    usable = (F.col("error") == "") & (F.col("text") != "")
    none = F.array().cast("array<struct<brand:string,position:int,is_domain_citation:boolean>>")
    return responses.withColumn("mentions", F.when(usable, let(X.fold(F.col("text")), hits)).otherwise(none))


def brand_mentions(analyses: DataFrame) -> DataFrame:
    rows = analyses.select("resp_id", "provider", "intent", "mentions")
    return unpack(rows, "mentions", "m").select("resp_id", "provider", "intent", "m.*")


def brand_stats(analyses: DataFrame, brands: list[Brand], grouping_sets: list[list[str]]) -> DataFrame:
    """Statistics per brand for each grouping of answers, in one aggregate.

    Failed answers stay in the denominators.  Every answer yields one short row per brand, combined map-side.
    ``framing`` (tone label by brand name, of the brands that were classified in the answer) is optional.
    """
    dims = sorted({c for s in grouping_sets for c in s})
    tones = F.col("framing") if "framing" in analyses.columns else F.lit(None).cast("map<string,string>")
    all_brands = F.array(*[F.struct(F.lit(i).alias("brand_no"), F.lit(b.name).alias("brand"), F.lit(b.is_target).alias("is_target")) for i, b in enumerate(brands)])
    rows = analyses.select(
        *dims, "web_search", tones.alias("tones"), F.size("mentions").alias("n_mentions"), "mentions", F.explode(all_brands).alias("b")
    )
    mine = F.get(F.filter("mentions", lambda m: m.brand == F.col("b.brand")), F.lit(0))
    rows = rows.select(
        *dims, "web_search", F.try_element_at("tones", F.col("b.brand")).alias("framing"), "n_mentions", F.col("b.brand_no").alias("brand_no"), F.col("b.brand").alias("brand"),
        F.col("b.is_target").alias("is_target"), mine.alias("m"),
    ).withColumn("hit", F.col("m").isNotNull())
    keys = ["brand_no", "brand", "is_target"]
    grouped = rows.groupingSets([[F.col(c) for c in [*s, *keys]] for s in grouping_sets], *[F.col(c) for c in [*dims, *keys]])
    labelled = F.col("hit") & F.col("framing").isNotNull()
    agg = grouped.agg(
        F.grouping_id().alias("gid"),
        F.count("*").alias("responses"),
        F.count_if("hit").alias("mentioned"),
        F.avg(F.when(F.col("hit"), F.col("m.position"))).alias("avg_position"),
        F.sum("n_mentions").alias("all_mentions"),
        F.count_if("web_search").alias("web_answers"),
        F.count_if(F.col("web_search") & F.col("hit") & F.col("m.is_domain_citation")).alias("citations"),
        F.count_if(labelled).alias("framed"),
        *[F.count_if(labelled & (F.col("framing") == f)).alias(f"n_{f}") for f in X.FRAMINGS],
    )
    share = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(F.lit(0.0))
    return agg.select(
        "gid", *dims, *keys, "responses",
        (F.col("mentioned") / F.col("responses")).alias("mention_rate"),
        "avg_position",
        share("mentioned", "all_mentions").alias("share_of_voice"),
        F.when(F.col("web_answers") > 0, F.col("citations") / F.col("web_answers")).alias("domain_citation_rate"),
        *[share(f"n_{f}", "framed").alias(f"framing_{f}") for f in X.FRAMINGS],
    )


def tones_by_brand(replies: DataFrame) -> DataFrame:
    """``resp_id, framing``: tone labels of an answer by brand.  ``replies``: resp_id, brand, reply, one row a brand asked about."""
    entry = F.struct("brand", X.framing_label(F.col("reply")).alias("framing"))
    unique = replies.where("brand IS NOT NULL").groupBy("resp_id", "brand").agg(F.max("reply").alias("reply"))
    return unique.groupBy("resp_id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("framing"))


def domain_terms(url: Column) -> Column:
    """Brand name, bare domain: distinct, three characters or more."""
    domain = F.lower(U.registrable_domain(url))
    bare = U.strip_www(domain)
    return F.array_distinct(F.filter(F.array(F.substring_index(bare, ".", 1), bare, domain), lambda t: F.length(t) >= 3))


def domain_mentioned(answer: Column, terms: Column) -> Column:
    """Does any term stand in the answer as a whole word?"""
    return let(X.fold(answer), lambda t: F.exists(terms, lambda term: X.mention_offset(t, X.fold(term)) > 0))


def visibility_questions(keywords: DataFrame, max_questions: int = MAX_QUESTIONS) -> DataFrame:
    """Questions from a site's ranked keywords (site, rank, keyword); words of the brand itself are left out."""
    terms = F.transform(domain_terms(F.concat(F.lit("https://"), "site", F.lit("/"))), X.fold)
    cleaned = F.array_join(F.filter(F.split("keyword", " "), lambda w: ~F.array_contains(terms, X.fold(w))), " ")
    usable = keywords.withColumn("topic", F.trim(cleaned)).where(F.length("topic") >= 3)
    rank = F.row_number().over(W.partitionBy("site").orderBy("rank"))
    return usable.withColumn("question_no", rank).where(F.col("question_no") <= max_questions).select(
        "site", "question_no", F.concat(F.lit("¿Cuáles son los mejores sitios web o marcas para «"), "topic", F.lit("»? Nombra varios.")).alias("question")
    )


def label_of(value: Column, labels: dict[str, str]) -> Column:
    from auditlake.operators.rules import lookup

    return F.coalesce(lookup(value, labels), value)


def answer_verdicts(answers: DataFrame, excerpt_chars: int | None = None) -> DataFrame:
    """Display rows of a visibility check; ``mentioned`` is already computed."""
    return answers.select(
        "resp_id",
        label_of(F.col("provider"), PROVIDER_LABELS).alias("provider"),
        "query",
        F.when(F.col("error") != "", F.lit("Error")).when(F.col("mentioned"), F.lit("Sí ✓")).otherwise(F.lit("No")).alias("verdict"),
        F.when(F.col("error") != "", F.col("error")).otherwise(F.col("text") if excerpt_chars is None else F.substring("text", 1, excerpt_chars)).alias("detail"),
    )


def mention_rate(answers: DataFrame) -> DataFrame:
    """Share of successful answers that mention the domain, by provider."""
    return answers.where("error = ''").groupBy("provider").agg(F.count("*").alias("answers"), F.avg(F.col("mentioned").cast("int")).alias("rate"))


def parse_battery(replies: DataFrame, intents: list[str], per_intent: int) -> DataFrame:
    """Query battery out of free text: fence removed, outermost braces read as JSON, first ``per_intent`` kept."""
    cleaned = F.trim(F.regexp_replace(F.trim("reply"), r"(?m)^```[a-zA-Z]*\n?|```$", ""))
    fenced = F.when(F.trim("reply").startswith("```"), cleaned).otherwise(F.trim("reply"))
    body = F.regexp_extract(fenced, r"(?s)(\{.*\})", 1)
    # one complete JSON value and nothing after it: wrapped in brackets it must be an array of one element
    whole = F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1
    parsed = F.when(whole, F.from_json(body, "map<string,array<string>>"))
    rows = replies.withColumn("battery", parsed).select(
        "doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("intent_no"), F.lit(n).alias("intent")) for i, n in enumerate(intents)])).alias("i"), "battery"
    )
    texts = F.slice(F.try_element_at("battery", F.col("i.intent")), 1, per_intent)
    listed = rows.select("doc_id", "i.intent_no", "i.intent", texts.alias("texts"))
    return unpack(listed, "texts", "text", "pos").drop("texts").withColumn("text", F.trim("text")).where("text <> ''")
