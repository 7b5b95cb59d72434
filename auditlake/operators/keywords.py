"""On-page keywords: weighted words and word pairs, scored inside each row (no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from auditlake.functions import text as X
from auditlake.functions.binding import unpack

_CONTENT_FIELDS = f"transform(fields, f -> struct(filter(f.words, w -> {X.IS_CONTENT_WORD}) AS words, f.weight AS weight))"
# Term order inside one field: all words first, then all pairs.  The sequence number breaks score ties.
_FIELD_TERMS = """
flatten(transform(fields, (f, i) -> concat(
  transform(f.words, (w, j) -> struct(w AS term, cast(i AS bigint) * 100000000 + j AS seq, f.weight AS weight)),
  CASE WHEN size(f.words) < 2 THEN cast(array() AS array<struct<term:string,seq:bigint,weight:int>>)
       ELSE transform(sequence(1, size(f.words) - 1), j ->
         struct(concat(element_at(f.words, j), ' ', element_at(f.words, j + 1)) AS term,
                cast(i AS bigint) * 100000000 + 50000000 + j AS seq, f.weight + 1 AS weight)) END)))
"""
# Runs of equal terms in the sorted array become one scored term: linear after the sort.
_STARTS = """
CASE WHEN size(terms) = 0 THEN cast(array() AS array<int>)
     ELSE filter(sequence(1, size(terms)), i -> i = 1 OR element_at(terms, i).term <> element_at(terms, greatest(i - 1, 1)).term) END
"""
_SCORED = """
transform(starts, (s, k) -> named_struct(
  'term', element_at(terms, s).term,
  'score', aggregate(slice(terms, s, coalesce(get(starts, k + 1), size(terms) + 1) - s), 0, (acc, t) -> acc + t.weight),
  'first_seq', element_at(terms, s).seq))
"""


def scored_terms(pages: DataFrame, body_chars: int | None = None) -> DataFrame:
    """Adds ``scored``: array of (term, score, first_seq).

    The score covers the whole body, or its opening ``body_chars`` characters.
    """
    body = F.col("text") if body_chars is None else F.substring("text", 1, body_chars)

    def field(text, weight: int):
        return F.struct(X.word_tokens(text).alias("words"), F.lit(weight).alias("weight"))

    fields = F.concat(
        F.array(field(F.col("title"), X.TITLE_WEIGHT)),
        F.transform("h1", lambda h: field(h, X.H1_WEIGHT)),
        F.array(field(F.col("meta_description"), X.DESCRIPTION_WEIGHT), field(body, X.BODY_WEIGHT)),
    )
    return (
        pages.withColumn("fields", fields)
        .withColumn("fields", F.expr(_CONTENT_FIELDS))
        .withColumn("terms", F.sort_array(F.expr(_FIELD_TERMS)))
        .withColumn("starts", F.expr(_STARTS))
        .withColumn("scored", F.expr(_SCORED))
        .drop("fields", "terms", "starts")
    )


def top_keywords(pages: DataFrame, top_n: int = X.TOP_KEYWORDS, body_chars: int | None = None) -> DataFrame:
    """Adds ``keywords``: the best terms, single words that sit inside a chosen pair left out."""
    ranked = F.expr(
        "slice(transform(array_sort(transform(scored, t -> struct(-t.score AS rank, t.first_seq AS seq, t.term AS term))), t -> t.term), 1, "
        f"{top_n * 3})"
    )
    chosen = F.aggregate(
        ranked,
        F.array().cast("array<string>"),
        lambda acc, t: F.when(
            (F.size(acc) >= top_n)
            | (~t.contains(" ") & F.exists(acc, lambda c: c.contains(" ") & F.array_contains(F.split(c, " "), t))),
            acc,
        ).otherwise(F.concat(acc, F.array(t))),
    )
    return scored_terms(pages, body_chars).withColumn("keywords", chosen).drop("scored")


def site_keywords(pages: DataFrame, limit: int = 6) -> DataFrame:
    """Most repeated page keywords per site; a site without any falls back to its shallowest page's own fields.

    ``pages`` carries ``keywords`` plus the text fields.  Ties keep first-seen order (page, then position).
    """
    counts = (
        unpack(pages.select("site", "page_id", "keywords"), "keywords", "keyword", "pos")
        .groupBy("site", "keyword")
        .agg(F.count("*").alias("pages"), F.min(F.struct("page_id", "pos")).alias("first_seen"))
    )
    best = W.partitionBy("site").orderBy(F.desc("pages"), "first_seen")
    top = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("site", "rank", "keyword", "pages")
    # min over a struct keeps one row per site through the partial aggregation: no site is gathered whole
    home = pages.groupBy("site").agg(
        F.max(F.size("keywords")).alias("most"),
        F.min(F.struct((F.col("depth") != 0).alias("deeper"), "page_id", "title", "h1", "meta_description")).alias("home"),
    ).where("most = 0")
    bare = home.select("site", "home.title", "home.h1", "home.meta_description", F.lit("").alias("text"))
    fallback = unpack(top_keywords(bare, limit).select("site", "keywords"), "keywords", "keyword", "pos").select(
        "site", (F.col("pos") + 1).alias("rank"), "keyword", F.lit(0).cast("long").alias("pages")
    )
    return top.unionByName(fallback)
