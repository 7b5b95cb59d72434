"""I-Match document fingerprints, with DataFrame functions only.

Document frequencies are counted over all documents in ``SLOTS`` hashed slots, so the lexicon has a fixed size and travels
in the plan as one bit string.  Terms whose slot lies in the band of inverse document frequency are kept, made distinct and
sorted; ``LEXICONS`` random lexicons, each thinned to ``RATES``, hash the kept terms that they contain.  A fingerprint is the
list of these hashes, 32 bits each, empty ones marked.

Two fingerprints are compared at the thinnest rate at which enough lexicons hit either document: the share that agree.
Equal fingerprints have likeness 1.  A null or empty text has the empty fingerprint, likeness 1 to another empty one and 0
to the rest.  A null doc_id orders after all others; among equal ids the text's hash decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F


SPACE = r"[\x20\x09-\x0D]+"
SLOTS = 1 << 20
LOW_IDF, HIGH_IDF = 1.0, 30.0  # terms in more than 1/e of the documents say nothing
LEXICONS = 8
RATES = (2, 8, 32, 128, 512)  # a lexicon keeps one in so many terms
ENOUGH = 4
EMPTY = "--------"


def _hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE, -1), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def _slot(h: Column) -> Column:
    return F.pmod(h, F.lit(SLOTS)).cast("int")


def lexicon(docs: DataFrame, low: float = LOW_IDF, high: float = HIGH_IDF, text: str = "text") -> bytes:
    """Seven slots a byte: a bit is set where ``low <= ln(documents / frequency) <= high``.  At most ``SLOTS`` rows reach the driver."""
    total = docs.count()
    slots = docs.select(F.explode(F.array_distinct(F.transform(_hashes(F.col(text)), _slot))).alias("slot"))
    most, least = total * math.exp(-low), total * math.exp(-high)
    table = bytearray(b"\x7f" * (SLOTS // 7 + 1))
    outside = slots.groupBy("slot").count().where((F.col("count") > most) | (F.col("count") < least))
    for row in outside.toLocalIterator():
        table[row["slot"] // 7] &= ~(1 << (row["slot"] % 7))
    return bytes(table)


def _held(table: bytes, slot: Column) -> Column:
    """The slot's bit."""
    byte = F.substring(F.lit(table), F.floor(slot / 7).cast("int") + 1, F.lit(1))
    return F.ascii(byte.cast("string")).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(7)]), F.pmod(slot, F.lit(7)) + 1)) != 0


def fingerprinted(docs: DataFrame, table: bytes, text: str, name: str) -> DataFrame:
    """Adds ``name``: an array of ``len(RATES) * LEXICONS`` hashes, thinnest rate last."""
    kept = F.filter(_hashes(F.col(text)), lambda h: _held(table, _slot(h)))
    out = docs.withColumn("_terms", F.sort_array(kept))
    for s in range(LEXICONS):
        held = "_terms"
        for rate in RATES:
            out = out.withColumn(f"_l{s}_{rate}", F.filter(held, lambda h: F.pmod(F.xxhash64(h, F.lit(s)), F.lit(rate)) == 0))
            held = f"_l{s}_{rate}"
    code = lambda c: F.when(F.size(c) == 0, F.lit(EMPTY)).otherwise(F.lower(F.lpad(F.hex(F.xxhash64(c).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))
    lists = [f"_l{s}_{rate}" for rate in RATES for s in range(LEXICONS)]
    return out.withColumn(name, F.array(*[code(F.col(c)) for c in lists])).drop("_terms", *lists)


def likeness(a: str, b: str) -> Column:
    """Share of agreeing lexicons at the thinnest rate that hits enough of them (0 to 1)."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == EMPTY) & (y == EMPTY), F.lit(None)).otherwise((x == y).cast("int")))
    out = F.lit(0.0)
    for i in range(len(RATES)):
        part = F.filter(F.slice(both, i * LEXICONS + 1, LEXICONS), lambda v: v.isNotNull())
        agree = F.size(F.filter(part, lambda v: v == 1)) / F.size(part)
        enough = 1 if i == 0 else ENOUGH
        out = F.when(F.size(part) >= enough, agree).otherwise(out)
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(out)


def followed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``next_<column>`` of the next row by descending doc_id (after the last: the first), in one shuffle.

    Rows go to as many ranges of ids as there are shuffle partitions; each range also gets a copy of the first row of the
    next one, so no range needs another.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    below = F.size(F.filter(F.lit(bounds), lambda b: b >= F.col("doc_id"))) if bounds else F.lit(0)
    rows = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(below)).withColumn("_tie", F.xxhash64("text"))
    order = F.struct(F.bitwise_not("doc_id").alias("k"), F.col("_tie").alias("t"))
    heads = sorted((r["_range"], r["head"]["k"], r["head"]["t"]) for r in rows.groupBy("_range").agg(F.min(order).alias("head")).collect())
    if not heads:
        return rows.select(docs["*"], *[F.col(c).alias(f"next_{c}") for c in columns])
    before = {heads[i][0]: heads[i - 1][0] for i in range(len(heads))}
    known = [~k for _, k, _ in heads if k is not None]
    wanted = F.col("doc_id").isin(known) if known else F.lit(False)
    for _, k, t in heads:
        if k is None:
            wanted = wanted | (F.col("doc_id").isNull() & (F.col("_tie") == t))
    shift = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    copies = rows.where(F.coalesce(wanted, F.lit(False))).withColumn("_range", F.element_at(shift, F.col("_range")))
    both = rows.withColumn("_copy", F.lit(False)).unionByName(copies.withColumn("_copy", F.lit(True)))
    along = W.partitionBy("_range").orderBy("_copy", F.desc_nulls_last("doc_id"), "_tie")
    both = both.withColumns({f"next_{c}": F.lead(c).over(along) for c in columns})
    return both.where("not _copy").select(*docs.columns, *[f"next_{c}" for c in columns])


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row, of its edited text and of the next row, with their likeness."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table = lexicon(docs)
    own = followed(fingerprinted(docs, table, "text", "own"), ["text", "own"])
    own = own.withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - third), F.left("next_text", third))
    own = own.withColumn("edited", edited).drop("text", "next_text")
    own = fingerprinted(own.withColumn("edited_sha256", F.sha2("edited", 256)), table, "edited", "changed").drop("edited")
    joined = lambda c: F.array_join(c, "")
    return own.select(
        "doc_id", "n_chars", "edited_sha256", joined("own").alias("fingerprint"), joined("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "next_own").alias("near_next"),
    )
