"""The conversation prefix trie against brute force, in one block and in many."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    cut = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: cut[c]] + own[c][cut[c] :] for c in own}


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = defaultdict(list)
    for k in members:
        if k:
            below[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in below[k]) or 1
        saved[k] = sum(saved[x] for x in below[k]) + (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
    ends = {k: ",".join(str(c) for c in sorted(v) if len(convs[c]) == len(k)) for k, v in members.items()}
    return [
        (min(v), len(k), min(members[k[:-1]]) if k else None, len(v), len(below[k]), leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest())
        for k, v in members.items()
    ]


def same(df, convs):
    got = sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)
    assert got == sorted(brute(convs), key=repr)


def conversations(seed, n=120):
    rnd = random.Random(seed)
    lines = ["hello", "Hello", "wie geht's", "übel", "", None, "a longer answer of some words"]
    rows = []
    for c in range(n):
        long = 40 if c % 17 == 0 else rnd.randint(1, 9)
        for turn in range(long):
            rows.append((c * 3 if c % 4 else c, turn, rnd.choice(["user", "assistant", None]) if c % 5 == 1 else ["user", "assistant"][turn % 2], rnd.choice(lines[: 2 + c % 6])))
    rows += [(None, 0, "user", "lost"), (1000, None, "user", "null first"), (1000, 0, "user", "second"), (1001, 5, None, None), (1003, 2**40, "system", "x" * 1_000_000)]
    return list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())


@pytest.mark.parametrize(("least", "most"), [(5_000, 500_000), (20, 20), (1, 3)])
def test_matches_brute_force(spark, least, most):
    rows = conversations(least)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit("x"), "depth": F.lit(1), "h": F.lit(0)})
    out = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(table)), least, most)
    same(out, rebuilt(rows))


def test_copies_of_one_conversation_over_many_blocks(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(90) for t in range(6)] + [(c, t, "user", f"turn {t}") for c in range(90, 100) for t in range(5 + c % 3)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    same(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(table)), 10, 30), rebuilt(rows))


def test_one_long_conversation_and_no_family(spark):
    rows = [(7, t, "user", str(t)) for t in range(5_000)] + [(8, 0, "user", "short")]  # 5, the first of their family, is absent
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    convs = rebuilt(rows)
    out = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(table)))
    assert out.count() == max(len(x) for x in convs.values()) + 1 + (len(convs[8]) > 0)
    root = out.where("depth = 0").first()
    assert (root["n_convs"], root["conv_id"], root["parent_conv_id"]) == (2, 7, None)


def test_repeated_rows_ties_and_an_empty_table(spark):
    rows = [(5, 1, "user", "a")] * 3 + [(5, 1, "assistant", "b"), (6, None, None, None), (6, None, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    same(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(table))), rebuilt(rows))
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns_of(table.where("false")))).collect() == []


def test_range_minimum_extents():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 64, 65):
        values = rnd.integers(0, 6, n)
        table = prefix_trie.RangeMinimum(values)
        for least in range(7):
            for at in range(n + 1):
                right = next((i for i in range(at, n) if values[i] < least), n)
                left = next((i + 1 for i in range(at - 1, -1, -1) if values[i] < least), 0)
                assert table.right(np.array([at]), np.array([least]))[0] == right
                assert table.left(np.array([at]), np.array([least]))[0] == left
