"""Quality rules: a threshold table compiled into one projection, without user functions.

Every measure is a whole number, every rule compares ``100 * measure`` with ``percent * base``: no rounding, so any SQL
engine gives the same verdict.  A null or blank text has no words, fails the base and is not kept; a null id stays null.
Repeated rows are judged alike, each by itself; columns of the input beside text are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "be", "by", "at", "or", "from", "this", "are", "an",
    "le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "est", "que", "qui", "dans", "pour", "pas", "sur", "au", "avec", "par",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "dem", "ein", "eine", "ist", "nicht", "auf", "für", "im", "auch",
    "el", "los", "las", "y", "una", "con", "no", "se", "su", "es", "lo", "del", "al", "como",
)


@dataclass(frozen=True)
class Rule:
    """``100 * measure`` must lie between ``least`` and ``most`` percent of ``base``; None: no bound."""

    name: str
    measure: str
    base: str
    least: int | None = None
    most: int | None = None

    def holds(self) -> Column:
        value, base = F.col(self.measure) * 100, F.col(self.base)
        ok = F.lit(True)
        if self.least is not None:
            ok = ok & (value >= base * self.least)
        if self.most is not None:
            ok = ok & (value <= base * self.most)
        return ok


#: Production thresholds.
RULES = (
    Rule("word_length", "word_chars", "n_words", least=200, most=1200),
    Rule("symbols", "n_symbols", "n_words", most=20),
    Rule("stop_words", "n_stop_words", "n_words", least=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=60),
)
MIN_WORDS, MOST_REPEATED = 50, 50
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures.  Windows are compared by a 64-bit hash inside one text; only texts with a repeated window are sorted."""
    step = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    step = step.withColumn("_words", F.array_remove(F.split("_text", SPACE, -1), ""))
    step = step.withColumn("_n", F.size("_words"))
    triple = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    starts = F.when(F.col("_n") >= 3, F.sequence(F.lit(0), F.col("_n") - 3)).otherwise(F.array().cast("array<int>"))
    step = step.withColumn("_hashes", F.transform(starts, triple))
    step = step.withColumn("_repeats", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    placed = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("_placed", F.when(F.col("_repeats"), placed))
    same = lambda x, j: (x["h"] == F.get("_placed", j)["h"])
    twice = F.filter("_placed", lambda x, j: F.coalesce(same(x, j + 1), F.lit(False)) | ((j > 0) & F.coalesce(same(x, F.greatest(j - 1, F.lit(0))), F.lit(False))))
    step = step.withColumn("_twice", twice)
    covered = F.size(F.array_distinct(F.flatten(F.transform("_twice", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    step = step.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    count = lambda c: c.cast("long")
    return step.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in MEASURES],
        count(F.col("_n")).alias("n_words"),
        count(F.char_length(F.array_join("_words", ""))).alias("word_chars"),
        count(F.regexp_count("_text", F.lit(SYMBOLS))).alias("n_symbols"),
        count(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        count(F.when(F.col("_repeats"), covered).otherwise(0)).alias("n_repeat_words"),
        count(F.size("_lines")).alias("n_lines"),
        count(F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS)))).alias("n_stop_words"),
    )


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds the measures, ``base_failed``, one boolean per rule (``ok_<name>``) and ``kept``."""
    out = measured(docs, text)
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    out = out.withColumn("base_failed", base).withColumns({f"ok_{r.name}": r.holds() for r in rules})
    verdict = ~F.col("base_failed")
    for r in rules:
        verdict = verdict & F.col(f"ok_{r.name}")
    return out.withColumn("kept", verdict)


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that are kept, with their own columns.

    The row number in the condition keeps the filter above the projection: pushed below, it would spell out every measure
    anew at each of its mentions.
    """
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{text}`").alias("text"))
    out = judged(carried, rules).withColumn("_row", F.monotonically_increasing_id())
    return out.where(F.col("kept") & (F.col("_row") >= 0)).select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
