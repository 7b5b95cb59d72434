"""Language identification with string kernels.

Kernel: two texts share the distinct 1- to 3-grams of letters they both have, ``|A & B| / sqrt(|A| |B|)`` (blended spectrum,
presence).  Nystroem landmarks, drawn evenly from the languages, turn it into features; one-versus-rest kernel ridge
regression on them gives a weight per landmark and language.  Whole texts are scored batch by batch with two matrix
products: presence of the landmarks' grams times the landmark matrix, then times the weights.

Symbols: 0 for anything but letters, 1-26 for a-z without case, the rest of the letters by a fixed rule on their lower-case
code point; 7 bits each, so grams are numbers below 2**21 and presence needs no sorting.

``SAMPLED`` labelled rows (about, by a hash of the id, evenly over languages) are all that is learned from.  A text that is
null or has no letter is ``und`` with score 0; so is everything if nothing is labelled.  Rows are judged one by one, so
repeated rows agree; an id may be null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from auditlake.llm.words import slices

SAMPLED = 4_000  # labelled rows used for fitting
LANDMARKS = 128
RIDGE = 1e-3
BITS, SYMBOLS = 7, 128
BLOCK = 256  # texts in a matrix product


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            low = ord(c.lower()[0])
            table[i] = low - 96 if 97 <= low <= 122 else 27 + low % 101
    return table


class Grams:
    """Distinct grams of texts, by marking a table with positions: the last mark of a gram stands for it."""

    def __init__(self) -> None:
        self.mark = np.zeros(1 << (3 * BITS), np.int32)

    def of(self, text: str) -> np.ndarray | None:
        """None without a letter."""
        s = _symbols()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
        if not s.any():
            return None
        two = (s[:-1] << BITS) | s[1:]
        three = (two[:-1] << BITS) | s[2:]
        # symbol 0 alone is never counted, so a shorter gram is told from a longer one by its leading symbol
        grams = np.concatenate([s[s > 0], two[s[:-1] > 0], three[s[:-2] > 0]]) if len(s) > 2 else np.concatenate([s[s > 0], two[s[:-1] > 0]])
        place = np.arange(len(grams), dtype=np.int32)
        self.mark[grams] = place
        return grams[self.mark[grams] == place]


class Model:
    """Landmark grams and weights."""

    def __init__(self, landmarks: list[np.ndarray], langs: list[str]):
        self.langs, vocabulary = langs, np.unique(np.concatenate(landmarks))
        self.column = np.full(1 << (3 * BITS), -1, np.int32)
        self.column[vocabulary] = np.arange(len(vocabulary))
        self.presence = np.zeros((len(vocabulary), len(landmarks)), np.float32)
        for j, grams in enumerate(landmarks):
            self.presence[self.column[grams], j] = 1
        self.norm = np.sqrt([len(g) for g in landmarks])
        self.weights = np.zeros((len(landmarks), len(langs)))

    def kernel(self, grams: list[np.ndarray]) -> np.ndarray:
        """Kernel of texts with the landmarks."""
        rows = np.zeros((len(grams), len(self.presence)), np.float32)
        for i, g in enumerate(grams):
            at = self.column[g]
            rows[i, at[at >= 0]] = 1
        own = np.sqrt([len(g) for g in grams])
        return (rows @ self.presence) / (own[:, None] * self.norm)  # counts are exact in single precision

    def __reduce__(self):
        grams = np.flatnonzero(self.column >= 0).astype(np.int32)
        return _restored, (grams, np.packbits(self.presence > 0, axis=1), self.presence.shape, self.norm, self.weights, self.langs)


def _restored(grams, bits, shape, norm, weights, langs) -> Model:
    model = Model.__new__(Model)
    model.column = np.full(1 << (3 * BITS), -1, np.int32)
    model.column[grams] = np.arange(len(grams))
    model.presence = np.unpackbits(bits, axis=1, count=shape[1]).astype(np.float32)
    model.norm, model.weights, model.langs = norm, weights, langs
    return model


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in slices(batches):
        found = [grams.of(t) for t in batch.column("text").to_pylist()]
        keep = [i for i, g in enumerate(found) if g is not None]
        yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(keep, pa.int64())), pa.array([found[i] for i in keep], pa.list_(pa.int32()))], names=["lang", "grams"])


def _sums(model: Model):
    """Per task: the features' products with themselves and with the targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, k = model.weights.shape
        inner, outer = np.zeros((m, m)), np.zeros((m, k))
        for batch in slices(batches):
            sets = Grams()
            rows = [(sets.of(t), lang) for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist())]
            rows = [r for r in rows if r[0] is not None]
            for i in range(0, len(rows), BLOCK):
                part = rows[i : i + BLOCK]
                c = model.kernel([g for g, _ in part])
                target = np.array([[1.0 if lang == own else -1.0 for own in model.langs] for _, lang in part])
                inner += c.T @ c
                outer += c.T @ target
        yield pa.RecordBatch.from_arrays([pa.array([inner.ravel()]), pa.array([outer.ravel()])], names=["inner", "outer"])

    return run


def fit(labelled: DataFrame, sampled: int = SAMPLED, landmarks: int = LANDMARKS, key: Column | None = None) -> Model | None:
    """Model of ``labelled`` (text, lang); ``key`` orders the rows at random, and nothing else.

    The driver gets the landmarks' grams and one small matrix per task; tasks over the sample are at most 16.
    """
    rows = labelled.where("lang is not null and text is not null").withColumn("_key", F.pmod(F.xxhash64("text") if key is None else key, F.lit(1_000_000)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    share = lambda each: F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1_000_000, -(-each * 1_000_000 // (len(langs) * counts[lang]))))])
    chosen = lambda each: rows.where(F.col("_key") < F.element_at(share(each), F.col("lang"))).select("lang", "text")
    found, missing, each, least = [], set(langs), 2 * landmarks, 100
    while missing:  # languages of which the share held no text of some length: a larger share, then shorter texts
        more = chosen(each).where(F.col("lang").isin(sorted(missing)) & (F.length("text") >= least))
        found += more.mapInArrow(_gram_rows, "lang string, grams array<int>").limit(4 * landmarks).collect()
        missing -= {r["lang"] for r in found}
        if each > len(langs) * max(counts.values()):
            if not least:
                break
            least = 0
        each *= 8
    if not found:
        return None
    found.sort(key=lambda r: (r["lang"], len(r["grams"]), r["grams"][:8]))
    picked: list[np.ndarray] = []
    for lang in langs:
        own = [r["grams"] for r in found if r["lang"] == lang]
        each = max(1, landmarks // len(langs))
        picked += [np.array(own[i * len(own) // each], np.int32) for i in range(min(each, len(own)))]
    model = Model(picked, langs)
    parts = chosen(sampled).repartition(16).mapInArrow(_sums(model), "inner array<double>, outer array<double>").collect()
    m, k = model.weights.shape
    inner = np.sum([p["inner"] for p in parts], axis=0).reshape(m, m)
    outer = np.sum([p["outer"] for p in parts], axis=0).reshape(m, k)
    own = model.kernel(picked)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # landmarks to Nystroem features
    gram = root.T @ inner @ root
    ridge = RIDGE * np.trace(gram) / len(gram)
    model.weights = root @ np.linalg.solve(gram + ridge * np.eye(len(gram)), root.T @ outer)
    return model


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Grams()
        for batch in slices(batches):
            grams = [sets.of(t or "") for t in batch.column("text").to_pylist()]
            lang, score = ["und"] * len(grams), np.zeros(len(grams))
            known = [i for i, g in enumerate(grams) if g is not None] if model is not None else []
            for a in range(0, len(known), BLOCK):
                part = known[a : a + BLOCK]
                values = model.kernel([grams[i] for i in part]) @ model.weights
                best = values.argmax(axis=1)
                for i, b, v in zip(part, best, values[np.arange(len(part)), best]):
                    lang[i], score[i] = model.langs[b], min(1.0, max(0.0, (1 + v) / 2))
            others = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*others, pa.array(lang), pa.array(score)], names=[*[c for c in batch.schema.names if c != "text"], "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``lang_pred`` and ``score``."""
    others = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_score(model), f"{fields}, lang_pred string, score double")
