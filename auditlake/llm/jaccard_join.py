"""N-gram Jaccard join with a token-group matrix: exact links of similarity 0.8 or more, as classes.

1. A profile per document: size and 128-bit digest of its set of word shingles, a few min-hashes, and the shingles that
   are common in its batch.  Documents with equal sets are one class, led by the smallest id.
2. Only shingles that come first in one global order (rare ones first, then by hash) can be needed: sets of similarity 0.8
   share ``SHARED`` shingles among the first ``n - ceil(0.8 n) + SHARED`` of each (all of them in a smaller set).  Shingles
   held by a single class are dropped, then classes left with fewer than that.  Of two sets, the one whose beginning ends
   first in that order can't hold its dropped shingles in common with the other (they would be in the other's beginning
   too), which bounds their overlap; the other's dropped shingles bound nothing.
3. Classes that share a min-hash are compared with the smallest of them: the links found partition similar documents
   into groups.
4. The token-group matrix holds each group's union of those shingles.  A query (a member of the smaller group) can be
   similar to a member of another group only if it hits the matrix there as often and the sizes allow it; such groups are
   opened and their members compared exactly.

The list of common shingles only orders them, so its bound changes the cost and never the result.  Exact sets decide.
A null, empty or blank text has an empty set and is linked with nothing; ids that repeat are one document per row, classes
name the smallest id; a row without id is kept, with its own null class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from auditlake.llm.components import Scratch, components
from auditlake.llm.words import grams, mix, signed, slices, squeezed, unsqueezed, words_of
from auditlake.operators.shuffle import stage

WORDS = 5
SIMILAR = 80  # percent
MIN_HASHES = 6
SHARED = 4  # shingles of the ordered beginnings that similar sets must share
COMMON = 200_000  # at most so many common shingles are known to the order (bounds the broadcast at 3.2 MB)
_SEEDS = [np.uint64(0x632BE59BD9B4E019 * (i + 1) % 2**64) for i in range(MIN_HASHES)]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    words = words_of(texts, lower=True)
    whole = grams(words.hash, WORDS, seed=1)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= WORDS:
            out.append(np.unique(whole[a : b - WORDS + 1]))
        else:
            out.append(grams(words.hash[a:b], max(int(b - a), 1), seed=2 + int(b - a)))
    return out


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=8 << 20):
        sets = shingle_sets(batch.column("text"))
        digests = [_digest(s) for s in sets]
        mins = [[int(m) for m in signed(np.array([mix(s ^ seed).min() for seed in _SEEDS], np.uint64))] if len(s) else None for s in sets]
        distinct = [sets[i] for i in {d: i for i, d in enumerate(digests)}.values()]
        tokens, count = np.unique(np.concatenate(distinct), return_counts=True)
        often = count >= 3
        n = len(sets)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(batch.column("doc_id").to_pylist() + [None], pa.int64()), pa.array([len(s) for s in sets] + [None], pa.int64()),
                pa.array(digests + [None], pa.binary()), pa.array([_short(d) for d in digests] + [None], pa.int64()),
                pa.array(mins + [None], pa.list_(pa.int64())),
                pa.array([None] * n + [signed(tokens[often])], pa.list_(pa.int64())), pa.array([None] * n + [count[often]], pa.list_(pa.int64())),
                pa.array(batch.column("hash").to_pylist() + [None], pa.int64()),
            ],
            names=["doc_id", "n_shingles", "id", "short", "mins", "tokens", "counts", "hash"],
        )


def first_tokens(tokens: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles of a set that any similar set must meet: rare ones by hash, then common ones by count and hash."""
    n = len(tokens)
    need = min(n, n - (SIMILAR * n + 99) // 100 + SHARED)
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        known = common[at] == tokens
        rare = tokens[~known]
        if len(rare) >= need:
            return rare[:need]
        held = tokens[known]
        order = np.lexsort((held, often[at[known]]))
        return np.concatenate([rare, held[order[: need - len(rare)]]])
    return tokens[:need]


def _prefixes(common: np.ndarray, often: np.ndarray):
    rank = np.empty(len(common), np.int64)
    rank[np.lexsort((common, often))] = np.arange(len(common))

    def end_of(first: np.ndarray, n: int) -> int:
        """Place in the global order up to which the whole set is known: below 0 for rare shingles (the hash without its last bit)."""
        if len(first) == n:
            return 2**63 - 1
        last = first[-1]
        at = int(np.searchsorted(common, last))
        return int(rank[at]) if at < len(common) and common[at] == last else (int(last) >> 1) - 2**63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owned: dict[int, np.ndarray] = {}
            ends: list[int | None] = []
            for s in shingle_sets(batch.column("text")):
                if len(s) and (key := _short(_digest(s))) not in owned:
                    owned[key] = first_tokens(s, common, often)
                    ends += [end_of(owned[key], len(s))] + [None] * (len(owned[key]) - 1)
            if owned:
                sizes = [len(x) for x in owned.values()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(np.concatenate(list(owned.values())))), pa.array(np.repeat(np.array(list(owned), np.int64), sizes)),
                        pa.array(ends, pa.int64()),
                    ],
                    names=["token", "short", "end"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in unsqueezed(batches):
        sets = shingle_sets(batch.column("text"))
        ids = pa.array([_digest(s) for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([ids, pa.array([signed(s) for s in sets], pa.list_(pa.int64()))], names=["id", "tokens"])


def _before(a: Column, b: Column) -> Column:
    """Place ``a`` is not after ``b``; equal places of rare shingles may hide a last bit and decide nothing."""
    return (a < b) | ((a == b) & (a >= 0))


def _most(n: Column, rest: Column, end: Column, size: Column, other: Column, first: Column, last: Column) -> Column:
    """Most shingles that a set can share with another whose beginning ends between ``first`` and ``last``.

    ``rest`` and ``other`` are the sizes without the shingles that no other beginning holds.
    """
    return F.least(n, size, F.greatest(rest, other), F.when(_before(end, first), rest), F.when(_before(last, end), other))


def _fits(a: str, b: str) -> Column:
    """Sizes and beginnings of two sets that allow the similarity."""
    n, k = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = _most(n, F.col(f"{a}.rest"), F.col(f"{a}.end"), k, F.col(f"{b}.rest"), F.col(f"{b}.end"), F.col(f"{b}.end"))
    return most * 100 >= (n + k - most) * SIMILAR


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose exact sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("_left"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("_right"))
    # both sides grow with the corpus: never broadcast, also where they happen to be small
    both = pairs.select("a", "b").hint("merge").join(left, "a").hint("merge").join(right, "b")
    shared = F.size(F.array_intersect("_left", "_right"))
    return both.where(shared * 100 >= (F.size("_left") + F.size("_right") - shared) * SIMILAR).select("a", "b")


def similarity_classes(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (doc_id, text); ``hashed`` adds the text's ``hash``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession)
    fields = "doc_id long, n_shingles long, id binary, short long, mins array<long>, tokens array<long>, counts array<long>, hash long"
    profile = stage(docs.withColumn("hash", F.xxhash64("text")).mapInArrow(_profile, fields), "profile")
    listed = profile.where("tokens is not null").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x"))
    listed = listed.groupBy(F.col("x.tokens").alias("token")).agg(F.sum("x.counts").alias("n")).orderBy(F.desc("n"), "token").limit(COMMON).toPandas()
    listed = listed.sort_values("token", key=lambda t: t.astype("int64").to_numpy().view(np.uint64))
    common, often = listed["token"].to_numpy(np.int64).view(np.uint64), listed["n"].to_numpy(np.int64)

    filled = profile.where("n_shingles > 0 and doc_id is not null").groupBy("id")
    classes = stage(filled.agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("short").alias("short"), F.first("mins").alias("mins")), "classes")
    rows = docs.mapInArrow(_prefixes(common, often), "token long, short long, end long")
    repeated = rows.groupBy("token").count().where("count > 1").select("token", F.lit(True).alias("met"))
    # the first row of each set also says where its beginning ends
    live = scratch.stage(rows.join(repeated, "token", "left").where("met or end is not null").distinct(), "tokens")
    ends = live.where("end is not null").groupBy("short").agg(F.min("end").alias("end"))
    live = live.where("met").select("token", "short")
    several = live.groupBy("token").agg(F.min("short").alias("lo"), F.max("short").alias("hi")).where("lo < hi").select("token")
    live = scratch.stage(live.join(several, "token", "left_semi"), "tokens")
    least = F.ceil(F.col("n") * SIMILAR / 100)
    enough = F.least(F.lit(SHARED), least)
    alone = F.greatest(F.least(F.col("n"), F.col("n") - least + SHARED) - F.col("count"), F.lit(0))
    held = live.groupBy("short").count().join(classes, "short").where(F.col("count") >= enough).join(ends, "short")
    held = scratch.stage(held.select("short", "id", "doc", "n", (F.col("n") - alone).alias("rest"), "end", "mins"), "held")

    keyed = held.select(F.struct("id", "n", "rest", "end").alias("own"), "doc", F.posexplode("mins").alias("i", "low"))
    leads = keyed.groupBy("i", "low").agg(F.min(F.struct("doc", "own")).alias("first"), F.count("*").alias("k"))
    leads = leads.where("k > 1").select("i", "low", F.col("first.own").alias("lead"))
    stars = keyed.join(leads, ["i", "low"]).where((F.col("own.id") != F.col("lead.id")) & _fits("own", "lead"))
    stars = scratch.stage(stars.select(F.col("own.id").alias("a"), F.col("lead.id").alias("b")).distinct(), "stars")
    wanted = held.select("doc").distinct()
    small = docs.mapInArrow(squeezed(["doc_id"]), "doc_id long, z binary")
    sets = scratch.stage(small.join(wanted.hint("merge"), small.doc_id == wanted.doc).select("z").mapInArrow(_sets, "id binary, tokens array<long>"), "sets")

    links = scratch.stage(_verified(stars, sets).distinct(), "links")
    member = held.select("short", "id", "n", "rest", "end").join(components(links), "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")
    extent = member.groupBy("group").agg(F.count("*").alias("members"))
    member = scratch.stage(member.join(extent, "group"), "members")
    cells = scratch.stage(live.join(member, "short").select("token", "id", "n", "rest", "end", "group", "members"), "cells")
    spread = cells.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("token")
    cells = scratch.stage(cells.join(spread, "token", "left_semi"), "matrix")
    spans = [F.min("n").alias("least"), F.max("n").alias("size"), F.max("rest").alias("rest"), F.min("end").alias("first"), F.max("end").alias("last")]
    matrix = cells.groupBy("token", "group", "members").agg(*spans)
    q, m = cells.alias("q"), matrix.alias("m")
    order = F.struct("q.members", "q.group") < F.struct("m.members", "m.group")
    most = _most(*(F.col(c) for c in ("q.n", "q.rest", "q.end", "m.size", "m.rest", "m.first", "m.last")))
    reach = most * 100 >= (F.col("q.n") + F.col("m.least") - most) * SIMILAR
    hits = q.join(m, F.col("q.token") == F.col("m.token")).where(order & reach)
    opened = hits.groupBy("q.id", "q.n", "q.rest", "q.end", "m.group").count().where(F.col("count") >= enough)
    opened = scratch.stage(opened.select(F.struct("id", "n", "rest", "end").alias("query"), "group"), "opened")
    inner = member.select("group", F.struct("id", "n", "rest", "end").alias("inner"))
    pairs = opened.join(inner, "group").where(_fits("query", "inner")).select(F.col("query.id").alias("a"), F.col("inner.id").alias("b")).distinct()
    final = components(links.union(scratch.stage(_verified(pairs, sets).distinct(), "links")))

    scratch.drop()
    labelled = classes.select("id", "doc").join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = labelled.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = labelled.join(least, "component").select("id", "component_id")
    own = profile.where("n_shingles is not null").select("doc_id", "n_shingles", "hash", F.when(F.col("n_shingles") > 0, F.col("id")).alias("id"))
    joined = own.join(named, "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return joined.select("doc_id", "n_shingles", component, *(["hash"] if hashed else []))
