"""Prefix scans over keys of any size, sorted grids and robots paths."""

import random
import urllib.robotparser

from pyspark.sql import functions as F

from auditlake.functions import urls as U
from auditlake.operators import history, robots, shuffle
from auditlake.operators.grid import SortedGrid
from helpers import values


def test_running_values_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(shuffle, "FAN", 3)  # several levels on few rows
    rng = random.Random(5)
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 4}", rng.choice([None, 1, 5, rng.randint(-9, 99)])) for i in range(-60, 400)]
    df = spark.createDataFrame(rows, "id long, k string, v long")
    for how, fold, empty in (("sum", sum, 0), ("max", max, None), ("min", min, None)):
        got = shuffle.running_before(df, "k", ["id"], F.floor(F.col("id") / 4), F.col("v"), how, "before")
        assert got.columns == ["id", "k", "v", "before"]
        want = {}
        for i, k, _ in rows:
            earlier = [v for j, other, v in rows if other == k and j < i and v is not None]
            want[i] = fold(earlier) if earlier else empty
        assert dict(values(got, "id", "before")) == want, how
    numbered = shuffle.number_within(df, "k", ["id"], F.floor(F.col("id") / 4))
    assert dict(values(numbered, "id", "rn")) == {i: sum(k == other and j <= i for j, other, _ in rows) for i, k, _ in rows}
    assert shuffle.number_within(df.limit(0), "k", ["id"], F.col("id")).count() == 0


def test_no_window_holds_a_whole_key(spark):
    df = spark.range(10).select("id", F.lit("hot").alias("k"))
    numbered = shuffle.number_within(df, "k", ["id"], F.floor(F.col("id") / 4096))
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    keys = [line[line.rindex("], [", 0, line.rindex("], [")) :] if line.count("], [") > 1 else line for line in windows]
    assert len(windows) == 4 and sum("_block" in k or "_head" in k for k in keys) >= 3  # the fourth sees a row per FAN * FAN blocks


def test_previous_snapshot_of_a_long_history(spark):
    crawls = [("s", t) for t in range(0, 3000, 7)] + [("t", 50)] + [("s", -20)]
    asked = [("s", t) for t in (-30, -20, -19, 0, 1, 7, 8, 2999, 99999)] + [("t", 50), ("t", 51), ("none", 5)]
    got = history.previous_snapshot(spark.createDataFrame(asked, "site string, before_ts long"), spark.createDataFrame(crawls, "site string, crawl_ts long"), width=16)
    want = {(s, t): max((c for o, c in crawls if o == s and c < t), default=None) for s, t in asked}
    assert {(s, b): p for s, b, p in values(got, "site", "before_ts", "previous_ts")} == want


def test_sorted_grid(spark, tmp_path):
    rows = [(i, None if i % 50 == 0 else "same" if i % 2 else f"t{i % 37}", i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "page_id long, title string, words long")
    for column, descending in (("title", False), ("title", True), ("words", True)):
        at = {"title": 1, "words": 2}[column]
        known = sorted([r for r in rows if r[at] is not None], key=lambda r: r[0])
        known.sort(key=lambda r: r[at], reverse=descending)
        nulls = [r for r in rows if r[at] is None]
        want = known + nulls if descending else nulls + known
        grid = SortedGrid(spark, str(tmp_path / f"{column}{descending}"), column, "page_id", descending)
        grid.save(df)
        assert len(grid.store.record()["parts"]) > 4  # a value of half the rows lies in several ranges
        for number in (0, 3, 19, 20):
            assert values(grid.page(number, 50), "page_id", "title", "words") == want[number * 50 : (number + 1) * 50], (column, number)
        assert [i for i, _ in sorted(values(grid.positions(), "page_id", "position"), key=lambda r: r[1])] == [r[0] for r in want]
        files = grid.page(3, 50).inputFiles()
        assert 0 < len({f.split("_range=")[1].split("/")[0] for f in files}) <= 2
    empty = SortedGrid(spark, str(tmp_path / "empty"), "title", "page_id")
    empty.save(df.limit(0))
    assert empty.page(0, 10).count() == 0 and empty.positions().count() == 0


RULES = ["/a%2fb/", "/caf%C3%A9", "/café/con%20leche", "/x y", "/%7Euser/", "/~user2", "/*", "*", "/q?a=%31", "/q?", "/p;x=1", "/p;", "/bad%zz", "/%E9t", "/long/prefix/one", "/long/prefix/two%2d", "/%", "/a%3Fb", "/plus+"]
PATHS = ["", "/", "/a/b/c", "/a%2Fb/c", "/caf%c3%a9/z", "/café", "/caf%C3%A9/con leche", "/x%20y", "/~user/1", "/%7euser2/", "/*", "/%2A", "/q?a=1", "/q?a=2", "/q", "/q?",
         "/p;x=1/y", "/p;x=12", "/p", "/p;", "/bad%zz/1", "/bad%25zz", "/%E9te", "/%C3%A9te", "/long/prefix/one/1", "/long/prefix/two-x", "/long/prefix/three", "/100%", "/%", "/a?b", "/a%3Fb=1", "/plus+1", "/plus%2B", "/f#frag", "/f#", "/f%23g"]


def test_escaped_robots_paths_agree_with_the_standard_parser(spark):
    sites = {f"s{i}": f"User-agent: *\nAllow: /long/prefix/one/1\nDisallow: {rule}\n" for i, rule in enumerate(RULES)}
    sites["all"] = "User-agent: *\n" + "".join(f"{'Allow' if i % 3 == 0 else 'Disallow'}: {rule}\n" for i, rule in enumerate(RULES))
    docs = spark.createDataFrame(list(sites.items()), "site string, text string")
    pages = spark.createDataFrame([(i, s, f"https://x.com{p}") for i, (s, p) in enumerate((s, p) for s in [*sites, "none"] for p in PATHS)], "page_id long, site string, url string")
    got = {(r.site, r.url): r.is_allowed for r in robots.robots_allowed(pages, docs, "Bot/1").collect()}
    assert len(got) == (len(sites) + 1) * len(PATHS) and all(v for (s, _), v in got.items() if s == "none")
    wrong = []
    for site, text in sites.items():
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(text.splitlines())
        wrong += [(site, p) for p in PATHS if got[(site, f"https://x.com{p}")] != parser.can_fetch("Bot/1", f"https://x.com{p}")]
    assert wrong == []


def test_percent_codes(spark):
    cases = ["", "abc", "%41%zz%", "%E4%BD%A0", "%ff", "é %/~*+", None]
    df = spark.createDataFrame([(c,) for c in cases], "x string")
    got = df.select(U.percent_decoded(F.col("x")).alias("d"), U.percent_encoded(F.col("x")).alias("e")).collect()
    from urllib.parse import quote, unquote

    assert [(r.d, r.e) for r in got] == [(None, None) if c is None else (unquote(c), quote(c)) for c in cases]
