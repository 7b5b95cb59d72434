"""Secret scans, URL filters and I-Match."""

import itertools
import random

from pyspark.sql import functions as F

from auditlake.llm import imatch, secret_scan, url_filter


def secret_rows():
    rnd = random.Random(5)
    hexa = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(120):
        value = [f'token = "{hexa(40)}"', f"password={hexa(18)}", "AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16))][i % 3]
        rows.append((i, f"some words here {value} and more é words", True))
        rows.append((1000 + i, f"the card {rnd.randint(10**15, 10**16 - 1)} was at http://host/path{i}/{hexa(20)} today", False))
    return rows


def test_forest_tells_secrets_from_numbers_and_paths(spark):
    rows = secret_rows()
    table = spark.createDataFrame([(i, t, 3) for i, t, _ in rows], "doc_id long, text string, start int").drop("start")
    texts = {i: t for i, t, _ in rows}
    out = secret_scan.findings(table).collect()
    assert out
    for r in out:
        assert texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] == r["value"]
        assert r["is_secret"] == (r["doc_id"] < 1000) and 0 <= r["score"] <= 1
    assert {r["doc_id"] for r in out if r["is_secret"]} == set(range(120))


def test_redaction_keeps_everything_else(spark):
    two = 'x token = "' + "0a" * 20 + '" y secret: ' + "b1" * 12 + " ünd z"
    rows = [(i, t) for i, t, _ in secret_rows()] + [(5000, two), (5001, None), (5002, ""), (5003, two), (None, "no secret")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("value", F.lit("mine"))
    out = {r["doc_id"]: (r["text"], r["value"]) for r in secret_scan.redacted(table).collect()}
    assert len(out) == len(rows)
    assert out[5000] == ('x token = "[SECRET]" y secret: [SECRET] ünd z', "mine") and out[5000] == out[5003]
    assert out[5001][0] is None and out[5002][0] == "" and out[None][0] == "no secret"
    assert all(out[i][0] == t for i, t in rows if i is not None and 1000 <= i < 2000)


def test_no_candidates_at_all(spark):
    table = spark.createDataFrame([(1, None), (2, "plain")], "doc_id long, text string")
    assert secret_scan.findings(table).collect() == [] and secret_scan.findings(table.where("false")).collect() == []


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = lambda s, marks: s[: min([s.index(m) for m in marks if m in s] or [len(s)])]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in url_filter.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else "allow"


def test_host_rules_match_brute_force(spark):
    hosts = ["a.net", "NET", "x.Example.net", "example.com", "www.example.com", "badexample.com", "b.org", "org", "É.org", ""]
    urls = [f"{s}{h}{p}" for s in ("http://", "x://y://", "") for h in hosts for p in ("", "/", "/en/", "/en", "/de/1?q=/fr/", "/fr/#x", "?a", "#/de/")] + [None, "://"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, token string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(pages, spark.createDataFrame([], "url string, bad boolean")).collect()}
    assert out == {i: brute_rule(u) for i, u in enumerate(urls)}


def test_mined_rules_match_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        parts = rnd.sample(["win", "casino", "news", "shop", "free"], 3)
        rows.append((f"http://h.com/{'/'.join(parts)}/", {"win", "free"} <= set(parts) and rnd.random() < 0.9 or rnd.random() < 0.05))
    labelled = spark.createDataFrame(rows + [(None, True), ("http://h.com/x", None)], "url string, bad boolean")
    got = {frozenset(items): round(c, 9) for items, c, _ in url_filter.mined(labelled, support=0.05, confidence=0.6)}
    baskets = [(frozenset(u.split("://")[1].replace(".", "/").strip("/").split("/")), bad) for u, bad in rows]
    words = sorted(set().union(*(b for b, _ in baskets)))
    found = {}
    for n in range(1, len(words) + 1):
        for items in map(frozenset, itertools.combinations(words, n)):
            held = [bad for b, bad in baskets if items <= b]
            if sum(held) >= 0.05 * len(rows) and sum(held) >= 0.6 * len(held):
                found[items] = round(sum(held) / len(held), 9)
    want = {k: c for k, c in found.items() if not any(p < k and found[p] >= c for p in found)}
    assert got == want and frozenset({"win", "free"}) in got
    pages = spark.createDataFrame([(1, "http://h.com/free/a/win"), (2, "http://h.com/free"), (3, None)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judged(pages, labelled).collect()} == {1: "block", 2: "allow", 3: "allow"}


def test_combinations_of_one_bad_host_leave_room_for_other_rules(spark):
    host = "http://" + ".".join(f"t{i}" for i in range(13))  # 8,191 combinations, all of confidence 1
    rows = [(f"{host}/x{i}", True) for i in range(200)] + [(f"http://ok.com/casino/y{i}", i % 10 > 0) for i in range(100)] + [(f"http://ok.com/z{i}", False) for i in range(300)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    assert [(items, round(c, 9)) for items, c, _ in url_filter.mined(labelled)] == [((t,), 1.0) for t in sorted(f"t{i}" for i in range(13))] + [(("casino",), 0.9)]
    pages = spark.createDataFrame([(1, "http://other.io/casino"), (2, "http://ok.com/a"), (3, "http://t5.io/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judged(pages, labelled).collect()} == {1: "block", 2: "allow", 3: "block"}


def test_fingerprints_of_edited_and_following_texts(spark):
    rnd = random.Random(2)
    text = lambda: " ".join(f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(30, 200)))
    rows = [(i * 5, text()) for i in range(60)] + [(301, None), (302, ""), (303, "é"), (None, "last one here")]
    rows += [(400, rows[0][1]), (401, rows[0][1])]
    out = {r["doc_id"]: r for r in imatch.compared(spark.createDataFrame(rows, "doc_id long, text string").withColumn("own", F.lit(1))).collect()}
    assert len(out) == len(rows)
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    import hashlib

    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        third = len(t) // 3
        assert out[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - third] + after[:third]).encode()).hexdigest()
        assert 0 <= out[d]["near_edited"] <= 1 and 0 <= out[d]["near_next"] <= 1
    assert out[0]["fingerprint"] == out[400]["fingerprint"] == out[401]["fingerprint"] and out[401]["near_next"] == 1.0
    long = [out[i * 5] for i in range(1, 60)]
    assert sum(r["near_edited"] for r in long) > 5 * sum(r["near_next"] for r in long)
    assert imatch.compared(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert imatch.compared(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()["near_next"] == 1.0
