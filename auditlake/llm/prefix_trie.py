"""Conversation prefix trie: every distinct sequence of first turns with its members, children, leaves and savings.

1. A turn becomes 128 bits of hash of (role, text) and its number of text bytes; a conversation is the sequence of these.
2. Sequences are range-partitioned and sorted, ties by id, so the members of every prefix lie next to each other.  A range is
   a block; the id takes part in the ranges, hence copies of one conversation spread over as many blocks as they need.
3. Per block: longest common prefixes (LCP) of neighbours, the first and last sequence of the next blocks included, and a
   sparse table of their range minima.  Each prefix that begins at a row searches its left and its right extent by halving
   steps over the table, all prefixes of a block at once and none knowing of another.  Sums over a row's contribution (each
   trie node is counted at the last row that has it) give the measures of an interval by two look-ups.
4. An interval that reaches a block's end is a partial node, at most as many per block as its neighbours' common prefixes are
   long.  Partial nodes are summed by prefix in Spark; the digest of their ends streams over per-block chunks in order.

Texts stay where they are read: only hashes are shuffled.  One conversation is held as 20 bytes a turn; a block holds at
most about ``MOST_BLOCK`` turns or one conversation, and one group of copies is never held as a whole.

Order: by turn, null first, ties by role, then by the text's hash.  A null role or text is empty.  Rows without
conversation id take no part; repeated rows are repeated turns; other columns are not read.  An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from auditlake.operators.shuffle import stage

SHARED, FAMILY = 9, 5
LEAST_BLOCK, MOST_BLOCK = 5_000, 500_000  # turns a block, if partitions allow the least
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_NODE = "p long, q long, depth long, conv_id long, parent_p long, parent_q long, n_convs long, n_children long, n_leaves long, saved_tokens long"
_SCHEMA = _NODE + ", parent_conv_id long, ends_sha256 string, partial boolean, block int, ends string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order, as structs (h, g, bytes)."""
    c = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    hashed = c.select(
        "conv_id",
        F.struct(
            "turn", "role", F.xxhash64("role", "text").alias("h"), F.xxhash64(F.lit(SHARED), "text", "role").alias("g"), F.octet_length("text").alias("bytes"),
        ).alias("t"),
    )
    ordered = hashed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["h"].alias("h"), t["g"].alias("g"), t["bytes"].alias("bytes"))).alias("turns"))


def shared_prefix(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its family's first one."""
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation with the first turns of its family's first one in place of as many of its own."""
    own = turns.withColumn("_h", shared_prefix(F.col("conv_id")).cast("int")).withColumn("_base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    first = turns.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, SHARED - 1).alias("_first"))
    none = F.slice("turns", 1, 0)
    taken = F.slice(F.coalesce("_first", none), F.lit(1), F.col("_h"))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(first, "_base", "left").select("conv_id", F.concat(taken, rest).alias("turns"))


def _lcp(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b)) // 2
    differ = (a[: 2 * n] != b[: 2 * n]).reshape(-1, 2).any(axis=1)
    return int(differ.argmax()) if differ.any() else n


def neighbour_lcp(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Common prefix, in turns, of each sequence and the next; sequence ``i`` is ``keys[at[i]:at[i + 1]]``, rows of two longs."""
    size = np.diff(at)
    both = np.minimum(size[:-1], size[1:])
    row = np.repeat(np.arange(len(both)), both)
    place = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
    differ = (keys[at[row] + place] != keys[at[row + 1] + place]).any(axis=1)
    out = both.copy()
    np.minimum.at(out, row[differ], place[differ])
    return out


class RangeMinimum:
    """Sparse table of range minima: level ``k`` has the minimum of every ``2 ** k`` consecutive values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (width := 1 << (len(self.levels) - 1)) <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from ``at`` on whose value is below ``least``, or the length."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            fits = at + (1 << k) <= len(self.levels[0])
            if len(level):
                at += (fits & (level[np.minimum(at, len(level) - 1)] >= least)).astype(at.dtype) << k
        return at

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of the values from ``low`` to before ``high``; no range is empty."""
        out = np.zeros(len(low), self.levels[0].dtype)
        level_of = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level_of):
            at = np.flatnonzero(level_of == k)
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << int(k))])
        return out

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from which on all values before ``at`` reach ``least``."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            fits = at >= 1 << k
            if len(level):
                at -= (fits & (level[np.maximum(at - (1 << k), 0)] >= least)).astype(at.dtype) << k
        return at


def prefix_hashes(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits that name the first ``d`` turns of each sequence, at ``at[i] + i + d``, the empty prefix included."""
    size, rows = np.diff(at), len(at) - 1
    begin = at[:-1] + np.arange(rows)
    out = np.zeros((len(keys) + rows, 2), np.uint64)
    state = np.tile(_SEEDS, (rows, 1))
    out[begin] = state
    order = np.argsort(-size, kind="stable")
    longest, alive = size[order], rows
    for d in range(int(size.max(initial=0))):
        alive = int(np.searchsorted(-longest[:alive], -d))  # sequences longer than d
        row = order[:alive]
        mixed = (state[row] ^ keys[at[row] + d].view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed = mixed * np.uint64(0x9FB21C651E98DF25) + np.uint64(d)
        state[row] = mixed ^ (mixed >> np.uint64(29)) ^ (state[row] << np.uint64(1))
        out[begin[row] + d + 1] = state[row]
    return out


class Counted:
    """Rows by a value, to count those of one value within a range of rows."""

    def __init__(self, values: np.ndarray, rows: np.ndarray, n: int):
        self.n, self.codes = n + 1, np.sort(values * (n + 1) + rows)

    def __call__(self, value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.codes, value * self.n + high) - np.searchsorted(self.codes, value * self.n + low)


def _nodes(key: tuple, rows: pa.Table, beside: pa.Table) -> pa.Table:
    """Nodes of one block; ``beside`` has the sequence before it (side 0) and the one after it (side 1), if any.

    A row's ``ahead`` is its common prefix with the next row, -1 after the very last.  A node of depth d ends at the row of
    its interval with ``ahead`` < d, and every sum below counts a node at that row only, so sums of blocks add up.
    """
    rows = rows.sort_by([("rank", "ascending")]).combine_chunks()
    n, every = rows.num_rows, np.arange(rows.num_rows)
    ids = rows.column("conv_id").to_numpy().astype(np.int64)
    seq = rows.column("seq").combine_chunks()
    flat = seq.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = seq.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) // 2
    keys, at = flat.reshape(-1, 2), np.concatenate([[0], np.cumsum(size)])
    sides = {s: np.array(v, np.int64) for s, v in zip(beside.column("side").to_pylist(), beside.column("seq").to_pylist())}
    before = _lcp(sides[0], flat[: 2 * at[1]]) if 0 in sides else -1
    after = _lcp(flat[2 * at[-2] :], sides[1]) if 1 in sides else -1
    lcp = neighbour_lcp(keys, at)
    ahead, table = np.append(lcp, after), RangeMinimum(lcp)

    # candidates: prefixes that the row before doesn't have; the first row has all of its own
    begins = np.concatenate([[-1], lcp])
    new = size - begins
    row = np.repeat(every, new)
    depth = np.arange(len(row)) - np.repeat(np.cumsum(new) - new, new) + begins[row] + 1
    low, high = table.left(row, depth), table.right(row, depth) + 1
    last = high - 1
    partial = ((low == 0) & (depth <= before)) | ((high == n) & (depth <= after))

    length = rows.column("bytes").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(length)])
    upto = lambda r, d: total[at[r] + d] - total[at[r]]  # noqa: E731  bytes of the first d texts of row r
    saves = np.where(ahead >= 0, upto(every, np.maximum(ahead, 0)), 0)
    sums = np.concatenate([[0], np.cumsum(saves)])
    open_end = ahead[last] >= depth
    saved = sums[last] - sums[low] + np.where(open_end, saves[last], 0) - (last - low + open_end) * upto(row, np.maximum(depth - 1, 0))
    leaves = np.concatenate([[0], np.cumsum(ahead < size)])
    forks = np.flatnonzero((ahead < size) & (ahead >= 0))
    children = Counted(ahead[forks], forks, n)(depth, low, last) + ((size[last] > depth) & (ahead[last] <= depth))
    ended = Counted(size, every, n)(depth, low, high)  # members of d turns come first in the interval, ids ascending
    least = RangeMinimum(ids).least(low, high)

    nothing, text = hashlib.sha256(b"").hexdigest(), [str(x) for x in ids.tolist()]
    digests, chunks = [], []
    for a, k, p in zip(low.tolist(), ended.tolist(), partial.tolist()):
        joined = ",".join(text[a : a + k]) if k else ""
        digests.append(None if p else hashlib.sha256(joined.encode()).hexdigest() if k else nothing)
        chunks.append(joined if p and k else None)

    # candidates are in order of row and depth, and a node's first candidate is at its left end
    name = prefix_hashes(keys, at).view(np.int64)
    own, up = name[at[row] + row + depth], name[at[row] + row + np.maximum(depth - 1, 0)]
    deep = int(size.max()) + 2
    parent = np.searchsorted(low * deep + depth, table.left(row, depth - 1) * deep + np.maximum(depth - 1, 0))
    root = depth == 0
    return pa.table(
        {
            "p": own[:, 0], "q": own[:, 1], "depth": depth, "conv_id": least, "parent_p": pa.array(up[:, 0], mask=root), "parent_q": pa.array(up[:, 1], mask=root),
            "n_convs": high - low, "n_children": children.astype(np.int64), "n_leaves": leaves[high] - leaves[low], "saved_tokens": saved,
            "parent_conv_id": pa.array(least[parent], mask=root | partial[parent]), "ends_sha256": pa.array(digests, pa.string()), "partial": partial,
            "block": pa.array(np.full(len(row), key[0].as_py(), np.int32)), "ends": pa.array(chunks, pa.string()),
        }
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One running digest per prefix over its chunks, which come in order; a chunk is one block's share."""
    name, state = None, hashlib.sha256()

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name[0]], pa.int64()), pa.array([name[1]], pa.int64()), pa.array([state.hexdigest()])], names=["p", "q", "ends_sha256"])

    for batch in batches:
        for p, q, chunk in zip(batch.column("p").to_pylist(), batch.column("q").to_pylist(), batch.column("ends")):
            if name == (p, q):
                state.update(b",")
            else:
                if name is not None:
                    yield done()
                name, state = (p, q), hashlib.sha256()
            state.update(chunk.as_py().encode())
    if name is not None:
        yield done()


def _blocks(sequences: DataFrame, least: int, most: int) -> DataFrame:
    """Sequences in order of turns and id, with ``block`` and ``rank``; ``sequences`` is stored."""
    turns = sequences.agg(F.coalesce(F.sum(F.size("bytes") + 1), F.lit(0))).first()[0]
    partitions = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = max(1, -(-turns // most), min(-(-turns // least), partitions))
    ordered = sequences.repartitionByRange(count, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    return stage(ordered.withColumn("block", F.spark_partition_id()).withColumn("rank", F.monotonically_increasing_id()), "trie-blocks")


def _beside(blocks: DataFrame) -> DataFrame:
    """``block, side, seq``: the last sequence before each block and the first one after it."""
    edges = stage(blocks.groupBy("block").agg(F.min_by("seq", "rank").alias("first"), F.max_by("seq", "rank").alias("last")), "trie-edges")
    held = sorted(r["block"] for r in edges.select("block").collect())  # one number a block
    spark = blocks.sparkSession
    after = spark.createDataFrame(list(zip(held, held[1:])), "block int, next int")
    ahead = after.join(edges.select(F.col("block").alias("next"), "first"), "next").select("block", F.lit(1).alias("side"), F.col("first").alias("seq"))
    back = after.join(edges.select("block", "last"), "block").select(F.col("next").alias("block"), F.lit(0).alias("side"), F.col("last").alias("seq"))
    return ahead.union(back)


def trie(sequences: DataFrame, least: int = LEAST_BLOCK, most: int = MOST_BLOCK) -> DataFrame:
    """Nodes of the trie over ``sequences`` (conv_id, turns: array of structs h, g, bytes).

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` and ``p, q``, the prefix's hash.
    """
    flat = sequences.select(
        "conv_id", F.flatten(F.transform("turns", lambda t: F.array(t["h"], t["g"]))).alias("seq"), F.transform("turns", lambda t: t["bytes"]).alias("bytes")
    )
    blocks = _blocks(stage(flat, "trie-sequences"), least, most)
    nodes = stage(blocks.groupBy("block").cogroup(_beside(blocks).groupBy("block")).applyInArrow(_nodes, _SCHEMA), "trie-nodes")
    whole, parts = nodes.where("not partial"), nodes.where("partial")
    chunks = parts.where("ends is not null").select("p", "q", "block", "ends").repartition("p", "q").sortWithinPartitions("p", "q", "block")
    ends = chunks.mapInArrow(_digests, "p long, q long, ends_sha256 string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = parts.groupBy("p", "q", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("parent_p").alias("parent_p"), F.max("parent_q").alias("parent_q"), *sums)
    merged = merged.join(ends, ["p", "q"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    merged = stage(merged.withColumn("parent_conv_id", F.lit(None).cast("long")), "trie-merged")
    columns = ["p", "q", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    known = "parent_conv_id is not null or depth = 0"
    open_nodes = whole.select(*merged.columns).where(f"not ({known})").union(merged.where("depth > 0"))
    above = merged.select(F.col("p").alias("parent_p"), F.col("q").alias("parent_q"), F.col("conv_id").alias("_above"))
    found = open_nodes.join(above, ["parent_p", "parent_q"], "left").withColumn("parent_conv_id", F.col("_above"))
    return whole.where(known).select(*columns).union(merged.where("depth = 0").select(*columns)).union(found.select(*columns))
