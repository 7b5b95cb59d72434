"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Leaf ``i`` of a piece's tree holds the rank of the pair that begins at byte ``i``, if that byte still begins a part; inner
nodes hold the minimum.  The walk from the root that prefers the left child finds the leftmost pair of least rank; a merge
sets three leaves (the pair itself, its left neighbour's, the part that vanished) and repairs their paths.  Short pieces of
one tree size run together, one numpy row each; a long piece has a tree of its own.

A null or empty text has no ids.  Ids without a vocabulary entry can't be decoded and raise.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from auditlake.llm.words import slices

NONE = np.int32(2**31 - 1)
SHORT = 64  # bytes; longer pieces are merged one by one
CACHED = 1_000_000  # pieces whose ids a task remembers
DECODED = 1 << 18  # ids decoded at once


class Vocabulary:
    """Ranks of a tiktoken file: ``ranks`` by bytes, ``data`` by id, and the rank of every pair that merges."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            lines = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        #: Bytes of all ids behind one another; id ``i`` has ``size[i]`` of them from ``at[i]`` on.
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {
            (left << 32) | right: rank
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None
        }
        order = np.argsort(keys := np.fromiter(self.pairs, np.int64, len(self.pairs)))
        self.keys = keys[order]
        self.values = np.fromiter(self.pairs.values(), np.int32, len(self.pairs))[order]

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``NONE`` where they don't merge."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def bytes_of(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where those of each id end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.size[ids].all()):
            raise KeyError("an id without vocabulary entry")
        size, out = self.size[ids], []
        ends = np.cumsum(size)
        for k in range(0, len(ids), DECODED):
            part = slice(k, k + DECODED)
            before = ends[k] - size[k]
            out.append(self.data[np.arange(before, ends[part][-1]) + np.repeat(self.at[ids[part]] - (ends[part] - size[part]), size[part])].tobytes())
        return b"".join(out), ends


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _merge_long(piece: bytes, v: Vocabulary) -> list[int]:
    """One tree for one piece."""
    n, width = len(piece), 1 << max(1, (len(piece) - 1).bit_length())
    ids = v.single[np.frombuffer(piece, np.uint8)].tolist()
    none, pairs = int(NONE), v.pairs
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = pairs.get((ids[i] << 32) | ids[i + 1], none)
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, rank: int) -> None:
        i += width
        tree[i] = rank
        while i > 1:
            i >>= 1
            low = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == low:
                break
            tree[i] = low

    while (rank := tree[1]) != none:
        i = 1
        while i < width:
            i = 2 * i if tree[2 * i] == rank else 2 * i + 1
        i -= width
        gone = following[i]
        after = following[gone]
        ids[i], following[i] = rank, after
        put(gone, none)
        if after < n:
            before[after] = i
        put(i, pairs.get((rank << 32) | ids[after], none) if after < n else none)
        if (left := before[i]) >= 0:
            put(left, pairs.get((ids[left] << 32) | rank, none))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = following[i]
    return out


def _merge_together(pieces: list[bytes], width: int, v: Vocabulary) -> list[list[int]]:
    """Trees of ``width`` leaves (a power of two) for pieces of at most as many bytes, all at once."""
    size = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
    ids = v.single[raw]
    place = np.arange(width)
    inside = place < size[:, None]
    following = np.tile(place + 1, (len(pieces), 1))
    before = np.tile(place - 1, (len(pieces), 1))
    tree = np.full((len(pieces), 2 * width), NONE, np.int32)
    leaf = v.pair(ids[:, :-1], ids[:, 1:])
    leaf[~inside[:, 1:]] = NONE
    tree[:, width : 2 * width - 1] = leaf
    for level in range(width.bit_length() - 2, -1, -1):
        a = 1 << level
        tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
    row = np.flatnonzero(tree[:, 1] != NONE)
    while len(row):
        rank = tree[row, 1]
        at = np.ones(len(row), np.int64)
        for _ in range(width.bit_length() - 1):
            at = 2 * at + (tree[row, 2 * at] != rank)
        at -= width
        gone = following[row, at]
        after = following[row, gone]
        ids[row, at] = rank
        following[row, at] = after
        ends = after >= size[row]
        right = np.minimum(after, width - 1)
        before[row[~ends], right[~ends]] = at[~ends]
        left = before[row, at]
        first = np.maximum(left, 0)
        tree[row, width + gone] = NONE
        tree[row, width + at] = np.where(ends, NONE, v.pair(rank.astype(np.int64), ids[row, right]))
        tree[row, width + first] = np.where(left < 0, tree[row, width + first], v.pair(ids[row, first], rank.astype(np.int64)))
        up = [width + gone, width + at, width + first]
        for _ in range(width.bit_length() - 1):
            up = [x >> 1 for x in up]
            for x in up:
                tree[row, x] = np.minimum(tree[row, 2 * x], tree[row, 2 * x + 1])
        row = row[tree[row, 1] != NONE]
    alive = np.zeros((len(pieces), width), bool)
    every = np.arange(len(pieces))
    at = np.zeros(len(pieces), np.int64)
    while len(every):
        alive[every, at] = True
        at = following[every, at]
        more = at < size[every]
        every, at = every[more], at[more]
    flat, counts = ids[alive], alive.sum(axis=1)
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


def encode_pieces(pieces: list[bytes], v: Vocabulary) -> list[list[int]]:
    """Ids of each piece; a piece that is itself in the vocabulary is one id."""
    out: list[list[int] | None] = [[v.ranks[p]] if p in v.ranks else None for p in pieces]
    waiting: dict[int, list[int]] = {}
    for i, done in enumerate(out):
        if done is None:
            n = len(pieces[i])
            if n > SHORT:
                out[i] = _merge_long(pieces[i], v)
            else:
                waiting.setdefault(1 << max(1, (n - 1).bit_length()), []).append(i)
    for width, group in waiting.items():
        for k in range(0, len(group), 1 << 14):
            part = group[k : k + (1 << 14)]
            for i, ids in zip(part, _merge_together([pieces[i] for i in part], width, v)):
                out[i] = ids
    return out


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        v, find = vocabulary(path), regex.compile(pattern).findall
        known: dict[str, bytes] = {}
        for batch in slices(batches):
            texts = [find(t or "") for t in batch.column("text").to_pylist()]
            fresh = list(set().union(*texts).difference(known))
            if len(known) + len(fresh) > CACHED:
                known.clear()
                fresh = list(set().union(*texts))
            for piece, ids in zip(fresh, encode_pieces([p.encode() for p in fresh], v)):
                known[piece] = np.array(ids, "<i4").tobytes()
            joined = [b"".join(map(known.__getitem__, parts)) for parts in texts]
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in joined])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(joined), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            row = 0
            while row < batch.num_rows:
                done = ends[row - 1] if row else 0
                stop = max(row + 1, int(np.searchsorted(ends, done + DECODED, "right")))
                part = batch.slice(row, stop - row)
                data, upto = v.bytes_of(part.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                at = np.append(0, upto)[np.append(0, ends[row:stop] - done)]
                text = pa.Array.from_buffers(pa.large_binary(), stop - row, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), text.cast(pa.binary())], names=["doc_id", "ids", "data"])
                row = stop

    return run


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` of each row of ``docs`` (doc_id, text): every match of ``pattern`` is encoded by itself."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode(path, pattern), "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, data``: the bytes of each list of ids."""
    return ids.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, ids array<int>, data binary")
