"""Packing token sequences: bounded-space online best fit with a fixed number of open windows.

Each task tokenizes its documents and keeps ``OPEN`` windows open.  Whole windows of a long document go out at once; a
remainder goes to the open window that it fills best.  When none fits and no further window may be opened, the fullest
one is topped up by a cut of the piece and emitted, so emitted windows are full.  What is open at a task's end is merged:
groups of ``MERGED`` tasks pack their leftovers by the same rule, and a group's last windows are cut into powers of two.

Memory: one document's ids and ``OPEN`` windows.  A null or empty text is its end id alone; a null doc_id stays null;
repeated rows are separate documents; other columns are not read.
"""

from __future__ import annotations

import array
import bisect
import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from auditlake.llm.words import slices
from auditlake.operators.shuffle import stage

WINDOW, OPEN, MERGED, END = 2048, 32, 64, 1
_FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks by bytes of a byte-level BPE file whose ids follow its merges and which changes nothing else; else None."""
    model, before, of = spec["model"], spec.get("pre_tokenizer") or {}, _byte_of()
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    if spec.get("normalizer") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token", "byte_fallback")):
        return None
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    added = {t["content"] for t in spec.get("added_tokens") or []}
    tokens = {t: i for t, i in model["vocab"].items() if t not in added}
    if merged != sorted(set(merged)) or len(tokens) != 256 + len(merged) or not all(c in tokens for c in of):
        return None
    return {bytes(of[c] for c in t): i for t, i in tokens.items()}


@lru_cache(maxsize=4)
def _encoder(path: str) -> Callable[[str], bytes]:
    """A text to little-endian 32-bit ids, as the tokenizers library gives them.

    A plain byte-level file is a table of ranks, for which tiktoken gives the same ids in a fifth of the time.  Texts that
    name an added token, and other kinds of files, go to the tokenizers library.  Nothing is remembered between texts.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    added, ranks = [t["content"] for t in spec.get("added_tokens") or []], _ranks(spec)
    if ranks is not None:
        import tiktoken

        fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        if ranks is None or any(a in text for a in added):
            return array.array("I", library.encode(text, add_special_tokens=False).ids).tobytes()
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    return encode


class Packer:
    """Open windows of one task.  ``emit`` is called with each finished list of pieces (doc_id, start, ids, doc_tokens)."""

    def __init__(self, emit: Callable[[list], None], window: int = WINDOW, most: int = OPEN):
        self.emit, self.window, self.most, self.made = emit, window, most, count()
        self.open: list[tuple[int, int, list]] = []  # (free, number, pieces), by free

    def add(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        at = 0
        while len(ids) - at >= self.window:
            self.emit([(doc_id, start + at, ids[at : at + self.window], doc_tokens)])
            at += self.window
        while at < len(ids):
            size = len(ids) - at
            place = bisect.bisect_left(self.open, (size, -1))
            if place < len(self.open):
                free, number, pieces = self.open.pop(place)
            elif len(self.open) < self.most:
                free, number, pieces = self.window, next(self.made), []
            else:
                free, number, pieces = self.open.pop(0)
            take = min(size, free)
            pieces.append((doc_id, start + at, ids[at : at + take], doc_tokens))
            at += take
            if take == free:
                self.emit(pieces)
            else:
                bisect.insort(self.open, (free - take, number, pieces), key=lambda w: w[:2])


def _rows(sequences: list[tuple[int, list]], with_ids: bool) -> dict[str, list]:
    out: dict[str, list] = {c.split()[0]: [] for c in _FIELDS.split(", ")}
    for number, pieces in sequences:
        offset = 0
        for doc_id, start, ids, total in pieces:
            data = ids.tobytes()
            for name, value in zip(out, (doc_id, start, len(ids), zlib.crc32(data), total, number, offset, data if with_ids else None)):
                out[name].append(value)
            offset += len(ids)
    return out


_TYPES = {**dict.fromkeys((c.split()[0] for c in _FIELDS.split(", ")), pa.int64()), "ids": pa.binary()}


def _batch(columns: dict[str, list], leftover: bool, part: int) -> pa.RecordBatch:
    n = len(columns["doc_id"])
    arrays = [pa.array(v, _TYPES[k]) for k, v in columns.items()] + [pa.array([leftover] * n, pa.bool_()), pa.array([part] * n, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=[*columns, "leftover", "part"])


def _pack(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = _encoder(path), TaskContext.get().partitionId()
        done: list[tuple[int, list]] = []
        numbers = count(part << 32)
        packer = Packer(lambda pieces: done.append((next(numbers), pieces)))
        end = np.array([END], "<u4").tobytes()
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.frombuffer(encode(text or "") + end, "<u4")
                packer.add(doc_id, 0, ids, len(ids))
            if done:
                yield _batch(_rows(done, with_ids), False, part)
                done.clear()
        left = [(next(numbers), pieces) for _, _, pieces in packer.open]
        if left:
            yield _batch(_rows(left, True), True, part)

    return run


def _merge(with_ids: bool):
    def run(key, frame):
        import pandas as pd

        done: list[tuple[int, list]] = []
        numbers = count((1 << 62) + (int(key[0]) << 32))
        packer = Packer(lambda pieces: done.append((next(numbers), pieces)))
        frame = frame.sort_values(["sequence_id", "offset"])
        docs = [None if pd.isna(d) else int(d) for d in frame["doc_id"]]
        for doc_id, start, data, total in zip(docs, frame["start"], frame["ids"], frame["doc_tokens"]):
            packer.add(doc_id, int(start), np.frombuffer(data, "<u4"), int(total))
        rest = [piece for _, _, pieces in packer.open for piece in pieces]
        size = sum(len(p[2]) for p in rest)
        while size:  # what is left: full windows, then powers of two
            cut = min(packer.window, 1 << (size.bit_length() - 1))
            size -= cut
            pieces = []
            while cut:
                doc_id, start, ids, total = rest.pop(0)
                take = min(cut, len(ids))
                pieces.append((doc_id, start, ids[:take], total))
                if take < len(ids):
                    rest.insert(0, (doc_id, start + take, ids[take:], total))
                cut -= take
            done.append((next(numbers), pieces))
        columns = _rows(done, with_ids)
        return pd.DataFrame({k: pd.array(v, "Int64") if k != "ids" else v for k, v in columns.items()})

    return run


def packed(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and ``ids``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = stage(docs.mapInArrow(_pack(path, with_ids), _FIELDS + ", leftover boolean, part long"), "packed")
    left = first.where("leftover").withColumn("merged", F.floor(F.col("part") / MERGED))
    merged = left.groupBy("merged").applyInPandas(_merge(with_ids), _FIELDS)
    out = first.where("not leftover").select(*merged.columns).unionByName(merged)
    return out if with_ids else out.drop("ids")
