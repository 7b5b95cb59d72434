"""Words of many texts at once: boundaries and 64-bit hashes over the bytes of an Arrow batch.

A word is a maximal run of anything but the six ASCII white-space bytes, which never occur inside a UTF-8 sequence.
Numpy works on slices of a megabyte, so memory depends on the longest single text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)


class Words(NamedTuple):
    """``hash``, ``start`` and ``end`` by word; words of text ``i`` are ``first[i]:first[i + 1]``."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a slice hold ``most`` bytes, or are one text."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, row = np.cumsum(size), 0
        while row < batch.num_rows:
            before = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(row, stop - row)
            row = stop


def squeezed(columns: list[str]):
    """For ``mapInArrow``: the text as compressed bytes ``z``, beside ``columns``: what is shuffled shrinks by a third."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in slices(batches):
            texts = (t if t is None else t.encode() for t in batch.column("text").to_pylist())
            z = [t if t is None else len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in texts]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(z, pa.binary())], names=[*columns, "z"])

    return run


def unsqueezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small slices of batches with ``z``, the text restored as ``text``."""
    codec = pa.Codec("zstd")
    for batch in slices(batches, "z", SLICE_BYTES // 2):
        z = batch.column("z").to_pylist()
        texts = [t if t is None else codec.decompress(t[8:], int.from_bytes(t[:8], "little"), asbytes=True).decode() for t in z]
        yield batch.append_column("text", pa.array(texts, pa.string()))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined UTF-8 bytes and the offset of each text; a null is empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _BASE)]))
    return _powers


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words of each text; ``lower`` folds A-Z only."""
    data, at = text_bytes(texts)
    inside = ~_SPACE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cut = at[(at > 0) & (at < len(data))]
    opens[cut] = inside[cut]
    closes[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, at)
    out = np.zeros(len(start), np.uint64)
    if len(start):
        power = _power(int((end - start).max()) + 1)
        value = _LOWER[data] if lower else data
        a = 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(end, start[a] + SLICE_BYTES)))
            lo, hi, begins = start[a], end[b - 1], start[a:b]
            held = inside[lo:hi]
            place = np.arange(lo, hi) - np.repeat(begins, np.diff(np.append(begins, hi)))
            place[~held] = 0
            piece = power[place]
            piece *= value[lo:hi].astype(np.uint64) + np.uint64(1)
            piece[~held] = 0
            out[a:b] = np.add.reduceat(piece, begins - lo)
            a = b
        out = mix(out + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(out, start, end, first, data)


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64((0xD1342543DE82EF95 + 2 * int(seed)) % 2**64)
    out = hashes[:m].copy()
    for j in range(1, k):
        out *= base
        out += hashes[j : j + m]
    return mix(out + np.uint64(int(seed)))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, held = x, 1
    while held < width:
        step = min(held, width - held)
        out = np.minimum(out[: len(out) - step], out[step:])
        held += step
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
