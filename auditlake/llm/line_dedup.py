"""Line dedup: a line that another document holds stays only in the document with the smallest id.

A line's key is the line without white space at its ends, A-Z in lower case, as two 64-bit hashes (128 bits together).

1. Lines with a key of at least ``LEAST`` code points become narrow rows (hashes, document, position), written once.
2. Rows are range-partitioned by hash and block with a secondary sort by document and position.  A block is a hash of
   document and position, so a line that a third of all rows hold is spread over as many tasks as there are partitions.
   Streaming over (hash, block), rows after the first document's are dropped at once.
3. The first documents of the blocks, at most one per block and key, are range-partitioned by hash and streamed once more.
4. Per document the dropped positions become a keep bitmap in run lengths: ``keep`` is an array of (from, lines) of kept
   runs.  Only a document that loses lines has one.

The text itself takes no part in any of these shuffles.  ``kept_lines`` joins the bitmaps to the texts.

A null or empty text is one empty line.  A row without id keeps every line and owns none.  Rows with one id are one
document: what only they hold is no repetition.  Repeated rows get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from auditlake.operators.shuffle import stage

LEAST = 10
SPACE = " \t\n\u000b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), _UPPER, _LOWER)


def line_rows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``h, g, doc_id, hash, pos`` of every line with a long enough key; ``docs`` has doc_id, text and hash."""
    lines = docs.where("doc_id is not null").select("doc_id", "hash", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= least)
    return keys.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(LEAST), "key").alias("g"), "doc_id", "hash", "pos")


def _streamed(rows: DataFrame, ranges: list[str], group: list[str]) -> DataFrame:
    """Adds ``first``: the first document of each group, met in order of document and position."""
    along = W.partitionBy(*group).orderBy("doc_id", "hash", "pos")
    return rows.repartitionByRange(*ranges).withColumn("first", F.first("doc_id").over(along))


def dropped_lines(rows: DataFrame) -> DataFrame:
    """``doc_id, hash, pos`` of the lines that a document with a smaller id has; ``rows`` as of ``line_rows``, stored."""
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(blocks)).cast("int"))
    within = stage(_streamed(cut, ["h", "block"], ["h", "g", "block"]).withColumn("later", F.col("doc_id") != F.col("first")).drop("first"), "lines")
    heads = _streamed(within.where("not later").drop("later", "block"), ["h"], ["h", "g"]).where("doc_id != first")
    return within.where("later").select("doc_id", "hash", "pos").union(heads.select("doc_id", "hash", "pos"))


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id, hash, n_dropped, keep`` of every document that loses lines; ``hash`` is the text's 64-bit hash.

    ``keep`` is the bitmap of kept lines in run lengths: ``array<struct<at int, n int>>``, ``at`` from 1; the last run ends
    at the largest whole number and is cut by the text's end.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stage(line_rows(docs.withColumn("hash", F.xxhash64("text")), least), "line-rows")
    gone = dropped_lines(rows).groupBy("doc_id", "hash").agg(F.sort_array(F.collect_set("pos")).alias("_gone"))
    # 0-based dropped positions p0 < p1 < ...: a kept run lies between each two of them, before the first and after the last
    ends = F.concat(F.array(F.lit(-1)), F.col("_gone"), F.array(F.lit(2**31 - 1)))
    gone = gone.withColumn("_ends", ends)
    between = F.transform(F.slice("_ends", 2, F.size("_ends") - 1), lambda end, i: F.struct((F.get("_ends", i) + 2).alias("at"), (end - F.get("_ends", i) - 1).alias("n")))
    return gone.select("doc_id", "hash", F.size("_gone").cast("long").alias("n_dropped"), F.filter(between, lambda r: r["n"] > 0).alias("keep"))


def kept_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped, kept`` of each row of ``docs``: ``kept`` is the text of the lines that stay."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = docs.withColumn("hash", F.xxhash64("text")).join(bitmaps, ["doc_id", "hash"], "left")
    lines = both.withColumn("_lines", lines_of(F.col("text")))
    runs = F.flatten(F.transform("keep", lambda r: F.slice("_lines", r["at"], r["n"])))
    kept = F.when(F.col("keep").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(runs, "\n"))
    return lines.select("doc_id", "text", F.size("_lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def deduplicated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``kept_lines`` with the bitmaps of ``docs`` itself, stored first."""
    return kept_lines(docs, stage(keep_bitmaps(docs, least), "bitmaps"))
