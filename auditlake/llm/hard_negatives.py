"""Hard-negative mining by a vertical scan (BOND) of whole-number vectors.

Anchors are taken in groups of ``GROUP`` rows; a group is broadcast and every task streams its rows past it in batches:

1. A batch is turned into columns, with each column's least and greatest value.
2. An anchor reads the columns in descending order of its own magnitudes, ``STEP`` at a time, for the rows of its candidate
   bitmap only.  After each step a row's score lies between its partial score and what the columns' extremes leave open.
3. Rows whose bounds can't reach the window any more, or not the rank asked for, lose their bit.  The columns left over are
   read for the rows that stay, so every returned score is exact.

The first pass finds the best rows of the anchor's label (positives).  Their scores give each (anchor, positive) a window
of scores; the second pass finds the best rows of other labels inside the windows.  A task keeps the best rows so far only;
they are ranked over all tasks in Spark.

Rows with a null id, label or vector, or a null or non-finite component take no part.  Of rows with one id the smallest
(label, vector) takes part.  A missing component counts as zero.  Ties go to the smaller id.  Scores are exact whole
numbers; one beyond 64 bits is reported as the nearest long.  An empty table has no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from auditlake.operators.shuffle import stage

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
GROUP, STEP, ROWS = 4_096, 16, 32_768
_LONG = (1 << 63) - 1


def quantized(vectors: DataFrame, label: Column) -> DataFrame:
    """``vec_id, label, v``: usable rows with components as whole numbers, one row an id."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * SCALE) == float("inf")))
    usable = usable.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull()).where(~bad)
    # floor() gives a long; a double of 2 ** 52 or more is whole already
    floor = lambda x: F.when(F.abs(x * SCALE) >= 2.0**52, x * SCALE).otherwise(F.floor(x * SCALE).cast("double"))
    whole = usable.select("vec_id", F.struct("label", F.transform("e", floor).alias("v")).alias("r"))
    return whole.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of whole numbers, padded by zeros; doubles if every product of two such rows is exact in them, else Python's own numbers."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(width, int(size.max(initial=0)))
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat
    if max(width, 1) * np.abs(out).max(initial=0) ** 2 < 2.0**52:
        return out
    return np.array([[int(x) for x in r] for r in out.tolist()], object).reshape(out.shape)


class Columns:
    """A batch of rows by column, with every column's least and greatest value."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.by = ids, labels, np.ascontiguousarray(rows.T)
        self.least, self.most = self.by.min(axis=1), self.by.max(axis=1)

    def scan(self, anchor: np.ndarray, rows: np.ndarray, narrowed: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Candidates left and their exact scores.  ``narrowed(lower, upper)`` says which of the candidates may stay."""
        n = min(len(anchor), len(self.by))
        anchor = anchor[:n]
        order = np.argsort(-np.abs(anchor), kind="stable")
        order = order[anchor[order] != 0]
        ends = np.stack([anchor[order] * self.least[:n][order], anchor[order] * self.most[:n][order]])
        low, high = ends.min(axis=0), ends.max(axis=0)
        below, above = low.sum() - np.cumsum(low), high.sum() - np.cumsum(high)
        score = np.zeros(len(rows), self.by.dtype)
        for k in range(0, len(order), STEP):
            part = order[k : k + STEP]
            score = score + anchor[part] @ self.by[part[:, None], rows]
            done = k + len(part) - 1
            stay = narrowed(score + below[done], score + above[done])
            if not stay.all():
                rows, score = rows[stay], score[stay]
            if not len(rows):
                break
        return rows, score


def _nth(score: np.ndarray, k: int):
    """The ``k``-th largest of at least ``k`` scores."""
    return (np.sort(score) if score.dtype == object else np.partition(score, len(score) - k))[len(score) - k]


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best rows, best first, ties by id."""
    held = np.flatnonzero(score >= _nth(score, k)) if len(score) > k else np.arange(len(score))
    return held[np.lexsort((ids[held], -score[held]))][:k]


class Kept:
    """The best ``k`` rows met so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> int | None:
        return self.score[-1] if len(self.score) == self.k else None

    def add(self, ids: np.ndarray, score: np.ndarray) -> None:
        if len(ids):
            if object in (score.dtype, self.score.dtype):
                score = np.array([int(x) for x in [*self.score, *score]], object)
            else:
                score = np.append(self.score, score)
            ids = np.append(self.ids, ids)
            best = _best(ids, score, self.k)
            self.ids, self.score = ids[best], score[best]


def positives_of(batch: Columns, anchor: np.ndarray, anchor_id: int, label: int, kept: Kept) -> None:
    """Adds the batch's best rows of the anchor's label."""
    rows = np.flatnonzero((batch.labels == label) & (batch.ids != anchor_id))

    def narrowed(lower, upper):
        floors = [x for x in (kept.floor, _nth(lower, kept.k) if len(lower) >= kept.k else None) if x is not None]
        return upper >= max(floors) if floors else np.ones(len(lower), bool)

    rows, score = batch.scan(anchor, rows, narrowed)
    kept.add(batch.ids[rows], score)


def negatives_of(batch: Columns, anchor: np.ndarray, label: int, windows: list[tuple[int, int]], kept: list[Kept]) -> None:
    """Adds the batch's best rows of other labels to each of the anchor's windows (least, most score)."""
    spans = [(least, most, held) for (least, most), held in zip(windows, kept) if least <= most]
    if not spans:
        return
    floor = min(least if held.floor is None else max(least, held.floor) for least, _, held in spans)
    ceiling = max(most for _, most, _ in spans)
    rows, score = batch.scan(anchor, np.flatnonzero(batch.labels != label), lambda lower, upper: (upper >= floor) & (lower <= ceiling))
    for least, most, held in spans:
        inside = (score >= least) & (score <= most)
        held.add(batch.ids[rows[inside]], score[inside])


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            yield Columns(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("v")))


def _aligned(anchors: np.ndarray, batch: Columns) -> tuple[np.ndarray, Columns]:
    """Both sides in one kind of number: 64 bits, or Python's own where a score might need more."""
    if anchors.dtype != object and batch.by.dtype != object:
        return anchors, batch
    if batch.by.dtype != object:
        batch = Columns(batch.ids, batch.labels, batch.by.T.astype(object))
    return anchors.astype(object), batch


def _limited(score: np.ndarray) -> list[int]:
    return [max(-_LONG - 1, min(_LONG, int(x))) for x in score]


def _positives(group, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows, _ = group.value
        kept = [Kept(k) for _ in ids]
        for batch in _columns(batches):
            anchors, batch = _aligned(rows, batch)
            for i, held in enumerate(kept):
                positives_of(batch, anchors[i], ids[i], labels[i], held)
        found = [(a, p, s) for a, held in zip(ids, kept) for p, s in zip(held.ids.tolist(), _limited(held.score))]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found) if found else ([], [], []))], names=["anchor_id", "positive_id", "positive_score"])

    return run


def windows(scores: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """The scores s with ``low * p <= 100 * s <= high * p``, as whole numbers; empty where least > most."""
    return [(-(-low * p // 100), high * p // 100) for p in scores]


def _negatives(group, k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows, positives = group.value
        spans = [windows([s for _, s in positives.get(a, ())], low, high) for a in ids]
        kept = [[Kept(k) for _ in x] for x in spans]
        for batch in _columns(batches):
            anchors, batch = _aligned(rows, batch)
            for i, held in enumerate(kept):
                negatives_of(batch, anchors[i], labels[i], spans[i], held)
        found = [
            (a, p, s, n, x)
            for a, held in zip(ids, kept)
            for (p, s), h in zip(positives.get(a, ()), held)
            for n, x in zip(h.ids.tolist(), _limited(h.score))
        ]
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found) if found else ([],) * 5)], names=names)

    return run


def _groups(anchors: DataFrame, size: int) -> Iterator[list]:
    """Anchors in groups of about ``size``, one group on the driver at a time."""
    count = max(1, -(-anchors.count() // size))
    for g in range(count):
        yield anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(count)) == g).toArrow().combine_chunks()


def mined(
    vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, group: int = GROUP
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of ``vectors`` that ``anchors`` selects.

    ``vectors`` is as of ``quantized``.  A negative's score lies between ``low`` and ``high`` per cent of the positive's.
    """
    spark = vectors.sparkSession
    vectors = stage(vectors, "vectors")
    best = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    closest = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    out = None
    for table in _groups(vectors.where(anchors), group):
        rows = [table.column("vec_id").to_pylist(), table.column("label").to_pylist(), _matrix(table.column("v").combine_chunks())]
        sent = spark.sparkContext.broadcast((*rows, {}))
        found = vectors.mapInArrow(_positives(sent, positives), "anchor_id long, positive_id long, positive_score long")
        chosen: dict[int, list[tuple[int, int]]] = {}
        for r in found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives).orderBy("anchor_id", "n").collect():  # a group's own
            chosen.setdefault(r["anchor_id"], []).append((r["positive_id"], r["positive_score"]))
        sent = spark.sparkContext.broadcast((*rows, chosen))
        near = vectors.mapInArrow(_negatives(sent, negatives, low, high), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        ranked = near.withColumn("rank", F.row_number().over(closest)).where(F.col("rank") <= negatives)
        part = stage(ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
        out = part if out is None else out.union(part)
    return out
