"""Similarity classes and repeated spans against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from auditlake.llm import jaccard_join, substring_dedup
from auditlake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed):
    """Copies, near copies, shared passages, short, empty, long and blank texts."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") * rnd.randint(1, 3)
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(rnd.randint(20, 90)) for _ in range(6)]
    passage = text(30)
    rows = []
    for i in range(70):
        kind = i % 7
        if kind == 0:
            t = base[i % 6]
        elif kind in (1, 2):
            w = base[i % 6].split(" ")
            for _ in range(rnd.randint(1, 3)):
                w[rnd.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind == 3:
            t = text(25) + "\n" + passage + "\t" + text(9)
        elif kind == 4:
            t = text(rnd.randint(1, 6))
        elif kind == 5:
            t = [None, "", " \n\t"][i % 3]
        else:
            t = text(rnd.randint(10, 200)).upper() if i % 2 else (text(4) + " ") * 9
        rows.append((i * 3 % 211, t))
    rows.append((500, text(6000)))
    return rows


def brute_classes(rows):
    sets, parent = {}, {}
    for d, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        parent[d] = d

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def brute_spans(rows, k):
    words = {d: WORD.findall(t or "") for d, t in rows}
    owner = {}
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            owner.setdefault(tuple(words[d][i : i + k]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - k + 1):
            if owner[tuple(w[i : i + k])] < d:
                gone |= set(range(i, i + k))
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_match_brute_force(spark, seed):
    rows = corpus(seed)
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "token": F.lit(1), "n": F.lit(None).cast("int")})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_classes(table).collect()}
    want = brute_classes(rows)
    assert got == want
    assert any(c != d for d, (_, c) in want.items())


def test_class_corner_cases(spark):
    text = "one two three four five six seven eight"
    table = spark.createDataFrame([(None, text), (7, text), (7, text), (9, text), (3, None), (4, "")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_classes(table).collect())
    assert got == [("3", 0, 3), ("4", 0, 4), ("7", 4, 7), ("7", 4, 7), ("9", 4, 7), ("None", 4, None)]
    assert jaccard_join.similarity_classes(table.where("false")).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 130)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, **{i: 100 for i in range(100, 130)}, 5: 5}


@pytest.mark.parametrize(("seed", "k"), [(1, 13), (3, 4)])
def test_spans_match_brute_force(spark, seed, k):
    rows = corpus(seed)
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"edge": F.lit("x"), "hash": F.lit(1), "owner": F.lit(2)})
    out = substring_dedup.repeated_spans(table, k=k, text=True).collect()
    want = brute_spans(rows, k)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out} == want
    assert any(0 < g < n for n, g, _ in want.values())
    for r in out:
        assert (r["kept"] is None) == (r["n_removed"] == 0)
        assert r["kept"] is None or hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def test_span_corner_cases(spark):
    text = " ".join(f"w{i}" for i in range(20))
    table = spark.createDataFrame([(None, text), (7, text), (7, text), (9, text), (3, None), (8, "x " + text)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup.repeated_spans(table).collect())
    assert got == [("3", 0, 0), ("7", 20, 0), ("7", 20, 0), ("8", 21, 20), ("9", 20, 20), ("None", 20, 0)]
    assert substring_dedup.repeated_spans(table.where("false")).collect() == []


def extended(seed):
    """Texts beside versions with passages added, cut off or replaced, their similarity about 0.75 to 0.95."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(10**6)}"
    rows = [(0, " ".join(f"a{i}" for i in range(104))), (1, " ".join(f"a{i}" for i in range(104)) + " " + " ".join(f"b{i}" for i in range(25)))]  # 100 of 125 shingles
    for i in range(60):
        w = [word() for _ in range(rnd.randint(60, 300))]
        versions = [w]
        for _ in range(rnd.choice([1, 1, 4])):
            k, kind = len(w) * rnd.randint(5, 27) // 100, rnd.choice("abcde")
            at = rnd.randint(0, len(w) - k)
            new = [word() for _ in range(k)]
            versions.append({"a": w + new, "b": w[:at] + new + w[at:], "c": w[k:], "d": w[:at] + w[at + k :], "e": w[: at + k // 3] + new[: k // 3] + w[at + k // 3 * 2 :]}[kind])
        rnd.shuffle(versions)
        rows += [(1000 * rnd.randrange(1, 9) + 10 * i + j, " ".join(v)) for j, v in enumerate(versions)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_extended_and_shortened_copies_are_linked(spark, seed):
    rows = extended(seed)
    want = brute_classes(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want[1] == (125, 0) and 40 < len({c for _, c in want.values()}) < len(want) - 20
    assert {d: g for d, g in got.items() if g != want[d]} == {}


def test_paths_are_the_nonbranching_ones(spark):
    """Edges, nodes and degrees of two repeated passages that part at a word, against a plain graph."""
    words = lambda s: s.split()
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "x a b c d q r s"), (4, "y a b c d q r s"), (5, "a b c d e f")]
    k, found = 3, {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1):
            found.setdefault(tuple(w[i : i + k]), []).append((d, i))
    ids = {e: n for n, e in enumerate(found)}
    node = {}
    number = lambda x: node.setdefault(x, len(node))
    table = [(ids[e], number(e[:-1]), number(e[1:]), d, 0, i) for e, places in found.items() for d, i in places]
    edges = spark.createDataFrame(table, "edge long, tail long, head long, doc_id long, hash long, pos int")
    got = sorted((r["doc_id"], r["start"], r["n"]) for r in substring_dedup.compacted(edges).collect())
    repeated = [e for e, places in found.items() if len(places) > 1]
    through = {n for n in {e[:-1] for e in repeated} if sum(e[:-1] == n for e in repeated) == 1 == sum(e[1:] == n for e in repeated)}
    assert {r["node"] for r in substring_dedup.through_nodes(spark.createDataFrame([(number(e[:-1]), number(e[1:])) for e in repeated], "tail long, head long")).collect()} == {node[n] for n in through}
    want = []
    for d, t in rows:
        w, path, last = words(t), None, None
        for i in range(len(w) - k + 1):
            e = tuple(w[i : i + k])
            owner = min(found[e])[0]
            if owner < d:
                if path and last == (i - 1, owner) and e[:-1] in through:
                    path[2] += 1
                else:
                    want.append(path := [d, i, 1])
                last = (i, owner)
            else:
                path = None
    assert got == sorted(map(tuple, want))
    assert len(want) > len({d for d, *_ in want})


def test_no_table_is_left(spark):
    before = {t.name for t in spark.catalog.listTables()}
    substring_dedup.repeated_spans(spark.createDataFrame(corpus(4), "doc_id long, text string")).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_spans_and_classes_of_a_text_of_20_mb(spark):
    long = " ".join(f"w{i % 70_000}x{i}" for i in range(1_600_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage + " own end"), (2, long + " " + passage), (3, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.repeated_spans(table).collect()}
    assert len(long) > 20_000_000 and got == {1: (62, 0), 2: (1_600_060, 60), 3: (0, 0)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_classes(table).collect()}
    assert got == {1: (58, 1), 2: (1_600_056, 2), 3: (0, 3)}
