"""Line dedup against brute force."""

import random

from pyspark.sql import functions as F

from auditlake.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, least=line_dedup.LEAST):
    owner = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= least:
                owner[key(line)] = min(d, owner.get(key(line), d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or owner.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def ordered(rows):
    return sorted(rows, key=repr)


def result(df):
    return ordered((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect())


def corpus(seed):
    rnd = random.Random(seed)
    pool = ["a line that many share", "A Line that MANY share", "  a line that many share\r", "Über den Wäldern", "über den wäldern", "short", "0123456789", "012345678", "　wide space stays　", ""]
    rows = [(i * 7 % 97, "\n".join(rnd.choice(pool) if rnd.random() < 0.7 else f"own line {rnd.randrange(40)} of it" for _ in range(rnd.randint(1, 12)))) for i in range(97)]
    return rows + [(200, None), (201, ""), (202, "\n\n"), (203, "trailing line here\n"), (204, "trailing line here\n"), (None, "a line that many share"), (None, None), (-5, "0123456789")]


def test_matches_brute_force(spark):
    rows = corpus(1)
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"hash": F.lit("x"), "pos": F.lit(1), "keep": F.lit(2), "n_dropped": F.lit(None).cast("int")})
    want = brute(rows)
    assert result(line_dedup.deduplicated(table)) == ordered(want)
    assert any(0 < dropped < n for _, n, dropped, _ in want)


def test_repeated_ids_rows_and_an_empty_table(spark):
    rows = [(7, "the same ten letters\nthe same ten letters"), (7, "the same ten letters\nthe same ten letters"), (7, "THE SAME TEN LETTERS"), (9, "x\nthe same ten letters"), (9, "the same ten letters")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(line_dedup.deduplicated(table)) == ordered(brute(rows))
    assert line_dedup.deduplicated(table.where("false")).collect() == []


def test_one_line_in_every_document_and_a_very_long_text(spark):
    hot = "a line found everywhere"
    rows = [(i, f"{hot}\nown line number {i}") for i in range(400)] + [(1000, "\n".join(f"line {i % 50_000} of a long text" for i in range(200_000)) + "\n" + hot)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(line_dedup.deduplicated(table)) == ordered(brute(rows))


def test_bitmaps_are_runs_of_kept_lines(spark):
    shared = [f"shared line {i}" for i in range(6)]
    rows = [(1, "\n".join(shared)), (2, "\n".join([shared[0], "own", "own", shared[1], shared[2], "own"])), (3, "\n".join(shared))]
    out = {r["doc_id"]: r for r in line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(out) == [2, 3]
    assert [(r["at"], r["n"]) for r in out[2]["keep"]][:2] == [(2, 2), (6, 2**31 - 6)]
    assert out[3]["n_dropped"] == 6


def test_plan_has_no_python(spark):
    plan = line_dedup.deduplicated(spark.createDataFrame(corpus(2), "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
