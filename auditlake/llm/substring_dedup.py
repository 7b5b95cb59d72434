"""Substring dedup over a de Bruijn graph of words: long spans that an earlier document already has are removed.

1. Anchors.  The smallest seven-word hash among those of a window of ``k`` words stands for the window; equal windows have
   equal anchors.  Anchors found in a single document are dropped, so most text never becomes an edge.  They
   have 48 bits: one that coincides with another costs an edge, never a result.
2. Edges.  The remaining windows are k-mer edges from the node of their first k - 1 words to that of their last, with their
   coordinates (document, position).  Per edge: the smallest document that has it (owner) and its number of occurrences.
   Edges are told apart by their own hash and that of the node they leave, 128 bits together.
3. Compaction.  Repeated edges joined on their ends give each node its in- and out-degree; a node with one edge in and one
   out does not branch.  An occurrence joins its edge; consecutive occurrences in a document that meet at such nodes and
   have one owner are a nonbranching path and become one row (document, start, length, digest of its edges).  Node hashes
   that coincide cost a longer list of paths, never a result.
4. Verification.  Each path row is checked against the words at its coordinates in the text itself: the
   combined hashes of its edges must be the digest that the edge table gave.  Verified rows of later documents are removed.

Exact copies of a text are found by a digest first: they lose every window at once and add no edges.
A null text has no words; a text shorter than ``k`` words keeps all.  A row without id is kept whole and owns nothing.
Rows that repeat an id and text get the same result; equal ids never count as an earlier document.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from auditlake.llm.components import Scratch
from auditlake.llm.words import Words, grams, signed, slices, sliding_min, squeezed, unsqueezed, words_of
from auditlake.operators.shuffle import stage

K = 13
ANCHOR = 7


def _windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window of one text begins, and the text of each."""
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    m = len(text) - k + 1
    at = np.flatnonzero(text[:m] == text[k - 1 :]) if m > 0 else np.zeros(0, np.int64)
    return at, text[at]


def _anchors_at(words: Words, at: np.ndarray, k: int) -> np.ndarray:
    short = min(ANCHOR, k)
    return sliding_min(grams(words.hash, short), k - short + 1)[at] >> np.uint64(16) if len(at) else np.zeros(0, np.uint64)


def _anchors(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = words_of(batch.column("text"))
            at, text = _windows(words, k)
            low = _anchors_at(words, at, k)
            if len(low):
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
                low, text = low[new], text[new]
                order = np.lexsort((low, text))
                low, text = low[order], text[order]
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(signed(low[new])), batch.column("doc_id").take(pa.array(text[new]))], names=["anchor", "doc_id"])

    return run


def _joined(words: Words, kept: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    data, out = words.data.tobytes(), []
    for a, b in zip(words.first[:-1], words.first[1:]):
        chosen = np.flatnonzero(kept[a:b]) + a
        out.append(b" ".join([data[i:j] for i, j in zip(words.start[chosen].tolist(), words.end[chosen].tolist())]))
    return out


def _finish(batch: pa.RecordBatch, words: Words, removed: np.ndarray, rows: np.ndarray, text: bool) -> pa.RecordBatch:
    """Result rows of the texts ``rows``."""
    counts = np.diff(words.first)
    gone = np.diff(np.concatenate([[0], np.cumsum(removed)])[words.first])
    kept = _joined(words, ~removed)
    pick = pa.array(rows)
    columns = [
        batch.column("doc_id").take(pick), batch.column("hash").take(pick), pa.array(counts[rows]), pa.array(gone[rows]),
        pa.array([hashlib.sha256(kept[i]).hexdigest() for i in rows], pa.string()),
    ]
    names = ["doc_id", "hash", "n_words", "n_removed", "kept_sha256"]
    if text:
        columns.append(pa.array([kept[i].decode() if gone[i] else None for i in rows], pa.string()))
        names.append("kept")
    return pa.RecordBatch.from_arrays(columns, names=names)


def _sorted_out(k: int, text: bool):
    """Texts without a repeated anchor and exact copies are finished; the others go on, with their repeated anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unsqueezed(batches):
            words = words_of(batch.column("text"))
            at, owner = _windows(words, k)
            low = _anchors_at(words, at, k)
            n = batch.num_rows
            copies = pc.fill_null(batch.column("copy"), False).to_numpy(zero_copy_only=False).astype(bool)
            hits = batch.column("anchors")
            listed = hits.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            has = np.zeros(n, bool)
            if len(listed):
                has[owner[np.isin(low, listed)]] = True
            has &= (pc.fill_null(pc.list_value_length(hits), 0).to_numpy(zero_copy_only=False) > 0) & ~copies
            removed = np.zeros(len(words.hash), bool)
            counts = np.diff(words.first)
            for i in np.flatnonzero(copies & (counts >= k)):
                removed[words.first[i] : words.first[i + 1]] = True
            done = _finish(batch, words, removed, np.flatnonzero(~has), text)
            rest = batch.take(pa.array(np.flatnonzero(has)))
            nothing = lambda m, kind: pa.nulls(m, kind)
            for part, own in ((done, True), (rest, False)):
                if part.num_rows:
                    m = part.num_rows
                    out = [part.column("doc_id"), part.column("hash")]
                    out += [part.column(c) if own else nothing(m, t) for c, t in (("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()))]
                    out += [part.column("kept")] if own and text else [nothing(m, pa.string())]
                    out += [nothing(m, pa.binary()), nothing(m, pa.list_(pa.int64()))] if own else [part.column("z").cast(pa.binary()), part.column("anchors").cast(pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(out, names=["doc_id", "hash", "n_words", "n_removed", "kept_sha256", "kept", "z", "anchors"])

    return run


def _nodes(words: Words, k: int) -> np.ndarray:
    """Hash of the first ``k - 1`` words of every window: the node that its edge leaves; the next one is where it leads."""
    return signed(grams(words.hash, k - 1, seed=5))


def _edges(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unsqueezed(batches):
            words = words_of(batch.column("text"))
            at, text = _windows(words, k)
            keep = np.isin(_anchors_at(words, at, k), batch.column("anchors").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            at, text = at[keep], text[keep]
            if len(at):
                take, node = pa.array(text), _nodes(words, k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(grams(words.hash, k, seed=3)[at])), pa.array(node[at]), pa.array(node[at + 1]),
                        batch.column("doc_id").take(take), batch.column("hash").take(take), pa.array((at - words.first[text]).astype(np.int32)),
                    ],
                    names=["edge", "tail", "head", "doc_id", "hash", "pos"],
                )

    return run


def through_nodes(edges: DataFrame) -> DataFrame:
    """``node`` for every node of ``edges`` (tail, head; one row an edge) with one edge in and one edge out."""
    leaving = edges.groupBy(F.col("tail").alias("node")).count().where("count = 1").select("node")
    entering = edges.groupBy(F.col("head").alias("node")).count().where("count = 1").select("node")
    return leaving.join(entering, "node")


def compacted(edges: DataFrame) -> DataFrame:
    """``doc_id, hash, start, n, digest`` of the nonbranching paths in which a document follows an earlier one."""
    repeated = edges.groupBy("edge", "tail").agg(F.min("doc_id").alias("owner"), F.count("*").alias("times"), F.min("head").alias("head"))
    repeated = stage(repeated.where("times > 1").drop("times"), "edges-repeated")
    marked = repeated.join(through_nodes(repeated).withColumn("through", F.lit(True)), F.col("tail") == F.col("node"), "left")
    marked = marked.select("edge", "tail", "owner", F.col("through").isNull().alias("opens"))
    later = edges.select("edge", "tail", "doc_id", "hash", "pos").join(marked, ["edge", "tail"]).where("doc_id > owner").drop("edge")
    along = W.partitionBy("doc_id", "hash").orderBy("pos")
    step = F.col("pos") - F.lag("pos").over(along)
    later = later.withColumn("step", step).withColumn("other", F.lag("owner").over(along) != F.col("owner"))
    begins = F.col("step").isNull() | (F.col("step") > 1) | ((F.col("step") == 1) & (F.col("opens") | F.col("other")))
    later = later.withColumn("path", F.sum(begins.cast("long")).over(along.rowsBetween(W.unboundedPreceding, 0)))
    once = F.when(F.coalesce(F.col("step"), F.lit(1)) > 0, F.col("tail"))  # a repeated row has every position again
    return later.groupBy("doc_id", "hash", "path").agg(
        F.min("pos").cast("long").alias("start"), (F.max("pos") - F.min("pos") + 1).cast("long").alias("n"), F.bit_xor(once).alias("digest")
    )


def _cut(k: int, text: bool):
    """Removes verified paths of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unsqueezed(batches):
            words = words_of(batch.column("text"))
            total = np.concatenate([np.zeros(1, np.int64), np.bitwise_xor.accumulate(_nodes(words, k))])
            own = batch.column("hash").to_pylist()
            marks = np.zeros(len(words.hash) + 1, np.int64)
            for i, paths in enumerate(batch.column("paths").to_pylist()):
                a, b = words.first[i], words.first[i + 1]
                for path in paths or ():
                    start, n = a + path["start"], path["n"]
                    if path["hash"] == own[i] and start + n + k - 1 <= b and int(total[start + n] ^ total[start]) == path["digest"]:
                        marks[start] += 1
                        marks[start + n + k - 1] -= 1
            removed = np.cumsum(marks)[:-1] > 0
            yield _finish(batch, words, removed, np.arange(batch.num_rows), text)

    return run


def bucketed(df: DataFrame, key: str, scratch: Scratch) -> tuple[DataFrame, str]:
    """Stored by buckets of ``key``, so a later join on it leaves these rows where they are; also the table's name."""
    spark = df.sparkSession
    name = f"spans_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).format("parquet")
    writer.option("path", f"{scratch.folder}/{name}").saveAsTable(name)
    return spark.table(name), name


def repeated_spans(docs: DataFrame, k: int = K, text: bool = False) -> DataFrame:
    """``doc_id, hash, n_words, n_removed, kept_sha256`` of each row of ``docs``; with ``text`` also ``kept``, what is left if words went.

    ``docs`` needs doc_id and text; ``hash`` is the text's 64-bit hash, which with doc_id names a row.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("hash", F.xxhash64("text"))
    digest = docs.select("doc_id", "hash", F.md5("text").alias("md5")).where("doc_id is not null and md5 is not null")
    lead = digest.groupBy("md5").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    copies = digest.join(lead, "md5").where("doc_id > lead").groupBy("doc_id").agg(F.collect_set("hash").alias("copies"))

    scratch, early = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    anchors = early.stage(docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(_anchors(k), "anchor long, doc_id long"), "anchors")
    repeated = anchors.groupBy("anchor").count().where("count > 1").select("anchor")
    hits = anchors.join(repeated, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    sorted_schema = "doc_id long, hash long, n_words long, n_removed long, kept_sha256 string, kept string, z binary, anchors array<long>"
    small = docs.mapInArrow(squeezed(["doc_id", "hash"]), "doc_id long, hash long, z binary")
    route = hits.join(copies, "doc_id", "full")
    routed = small.join(route, "doc_id", "left").withColumn("copy", F.array_contains("copies", F.col("hash"))).drop("copies")
    first, table = bucketed(routed.mapInArrow(_sorted_out(k, text), sorted_schema), "doc_id", scratch)
    early.drop()

    rest = first.where("z is not null")
    edges = rest.select("doc_id", "hash", "z", "anchors").mapInArrow(_edges(k), "edge long, tail long, head long, doc_id long, hash long, pos int")
    paths = compacted(edges).groupBy("doc_id").agg(F.collect_list(F.struct("hash", "start", "n", "digest")).alias("paths"))
    shape = "doc_id long, hash long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if text else "")
    last = rest.select("doc_id", "hash", "z").join(paths, "doc_id", "left").mapInArrow(_cut(k, text), shape)
    out = stage(first.where("z is null").select(*last.columns).unionByName(last), "spans")
    docs.sparkSession.sql(f"DROP TABLE {table}")
    scratch.drop()
    return out
