"""Hard-negative mining against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=10):
    held = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        row = (label, [math.floor(256 * x) for x in e])
        held[i] = min(row, held.get(i, row))
    score = lambda a, b: sum(x * y for x, y in zip(held[a][1], held[b][1]))
    out = []
    for a in sorted(held):
        if a % every:
            continue
        best = sorted((-score(a, i), i) for i in held if i != a and held[i][0] == held[a][0])[: hard_negatives.POSITIVES]
        for s, p in best:
            near = sorted((-score(a, i), i) for i in held if held[i][0] != held[a][0] and 30 * -s <= 100 * score(a, i) <= 90 * -s)
            out += [(a, p, k + 1, n, -s, -x) for k, (x, n) in enumerate(near[: hard_negatives.NEGATIVES])]
    return out


def result(spark, rows, parts=3, **kw):
    table = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({"anchor_id": F.lit("x"), "v": F.lit(1), "rank": F.lit(None).cast("int")})
    out = hard_negatives.mined(hard_negatives.quantized(table, F.col("label")), F.col("vec_id") % 10 == 0, **kw)
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in out.collect())


def vectors(seed, n=240, width=20):
    rnd = random.Random(seed)
    centre = [[rnd.gauss(0, 0.2) for _ in range(width)] for _ in range(4)]
    return [(i, [x + rnd.gauss(0, 0.15) for x in centre[i % 4]], i % 4 if rnd.random() < 0.8 else rnd.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("group", [4_096, 7])
def test_matches_brute_force(spark, group):
    rows = vectors(1)
    rows += [(1000, None, 1), (1010, [0.1] * 20, None), (1020, [0.1, None], 1), (1030, [math.nan], 2), (1040, [math.inf], 2), (None, [0.5] * 20, 1)]
    rows += [(1050, [], 3), (1060, [0.3, 0.2], 3), (1061, [0.0] * 20, 3), (-10, [0.25] * 24, 0), (5, rows[5][1], 3), rows[8], rows[8]]
    want = brute(rows)
    assert result(spark, rows, group=group) == sorted(want)
    assert len(want) > 500


def test_ties_and_one_vector_in_a_third_of_the_rows(spark):
    rnd = random.Random(2)
    rows = [(i, [0.5, -0.25, 0.125] if i % 3 == 0 else [rnd.choice([0.0, 0.25, 0.5]) for _ in range(3)], i % 2) for i in range(200)]
    assert result(spark, rows, parts=5) == sorted(brute(rows))


def test_scores_beyond_a_double(spark):
    rows = [(i, [float(2**24 + i), 1.5 * i, -(2.0**22)], i % 2) for i in range(40)]
    rows += [(40, [0.25, 0.5, 0.75], 0), (41, [0.5, 0.5, 0.5], 1)]
    assert result(spark, rows) == sorted(brute(rows))


def test_empty_tables_and_a_single_label(spark):
    assert result(spark, []) == []
    assert result(spark, [(i, [1.0, 0.5], 1) for i in range(30)]) == []


def test_scan_prunes_and_stays_exact():
    rnd = np.random.default_rng(3)
    rows = np.floor(rnd.normal(0, 10, (500, 32)))
    rows[:, 0] *= 40
    batch = hard_negatives.Columns(np.arange(500), np.zeros(500, int), rows)
    seen = []

    def narrowed(lower, upper):
        seen.append(len(lower))
        return upper >= np.sort(lower)[-5]

    left, score = batch.scan(rows[7], np.arange(500), narrowed)
    exact = rows @ rows[7]
    assert seen[-1] < 500 and (score == exact[left]).all()
    assert set(np.argsort(-exact)[:5]) <= set(left.tolist())
