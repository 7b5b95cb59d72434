"""Versioned tables and the audit kept between crawls."""

import pytest
from pyspark.sql import functions as F

from auditlake.operators import aggregates as A, duplicates, rules
from auditlake.operators.audit_store import AuditStore
from auditlake.operators.facts import page_facts, without_blocked
from auditlake.sources.versions import VersionedTable
from helpers import fetch, fetches, values


def test_only_committed_versions_are_seen(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(LookupError):
        table.read()
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "x long")
    assert [table.write(rows(1, 2), info={"run": "a"}), table.write(rows(3), info={"run": "b"})] == [1, 2]
    rows(9).write.parquet(str(tmp_path / "t" / "data-half-written"))  # a run that stopped before its record
    assert values(table.read(), "x") == [(3,)] and sorted(values(table.read(1), "x")) == [(1,), (2,)]
    assert [(v["version"], v["info"]["run"]) for v in table.versions()] == [(1, "a"), (2, "b")]
    table.clear(keep=1)
    assert [v["version"] for v in table.versions()] == [2] and values(table.read(), "x") == [(3,)]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")]) == 1
    table.clear()
    assert table.versions() == [] and table.record() is None


def test_a_write_replaces_its_buckets_only(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    rows = lambda *x: spark.createDataFrame(list(x), "b int, x string")
    table.write(rows((0, "a"), (1, "b"), (2, "c")), "b")
    table.write(rows((1, "B"), (1, "BB")), "b")
    assert sorted(values(table.read(), "x")) == [("B",), ("BB",), ("a",), ("c",)]
    assert sorted(values(table.read(1), "x")) == [("a",), ("b",), ("c",)]
    assert sorted(values(table.read(buckets=[1]), "x")) == [("B",), ("BB",)]
    table.clear(keep=1)
    assert sorted(values(table.read(), "x")) == [("B",), ("BB",), ("a",), ("c",)]
    assert table.write(rows(), "b") == 3 and table.read().count() == 4


def _html(text):
    return f"<html><head><title>{text}</title></head><body><h1>{text}</h1><a href='/x'>x</a></body></html>"


def _crawl(n=200, sites=("a", "b", "c"), changed=(), shift=0):
    rows = []
    for i in range(n):
        site = sites[i % len(sites)]
        text = f"page {i // 4}" + (" neu" if i in changed else "")
        rows.append(fetch(1000 * shift + i, f"https://{site}.com/{i}", _html(text), depth=i % 3, site=site, status=404 if i % 17 == 0 else 200))
    return rows


def _audit(pages):
    counted = duplicates.with_duplicate_counts(pages).drop("outlinks", "image_srcs")
    return rules.collect_page_issues(counted.withColumn("is_orphan", F.col("page_id") % 7 == 0))


def test_a_second_crawl_parses_what_has_changed(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path), buckets=4)
    with pytest.raises(LookupError):
        store.audited()
    first = store.crawl(fetches(spark, _crawl()), _audit)
    assert (first["pages"], first["parsed"], first["reused"]) == (200, 200, 0)
    rows = _crawl(changed=(5, 77), shift=1)
    second = store.crawl(fetches(spark, rows), _audit)
    assert (second["pages"], second["parsed"], second["reused"]) == (200, 2, 198)
    want = page_facts(fetches(spark, rows))
    assert sorted(map(str, store.facts().select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert store.audited().where("title = 'page 1 neu'").count() == 1
    assert store.audited(first["version"]).where("title = 'page 1 neu'").count() == 0


def test_a_crawl_leaves_other_sites_alone(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path), buckets=3)
    store.crawl(fetches(spark, _crawl()), _audit)
    before = {r["site"]: r for r in store.page_states().collect()}
    part = [r for r in _crawl(changed=(3, 6), shift=2) if r[1] == "a"][:30]  # a smaller site a: pages vanish
    record = store.crawl(fetches(spark, part), _audit)
    assert (record["pages"], record["parsed"]) == (30, 2)
    after = {r["site"]: r for r in store.page_states().collect()}
    assert after["b"] == before["b"] and after["c"] == before["c"] and after["a"]["total_pages"] == 30
    assert store.audited().count() == 30 + before["b"]["total_pages"] + before["c"]["total_pages"]
    whole = store.audited()
    assert sorted(values(A.page_states(whole), *store.page_states().columns)) == sorted(values(store.page_states(), *store.page_states().columns))
    columns = ["site", "code", "category", "severity", "findings", "pages"]
    assert sorted(values(A.code_states(whole), *columns)) == sorted(values(store.code_states(), *columns))


def test_states_of_parts_add_up(spark):
    pages = _audit(page_facts(fetches(spark, _crawl()))).withColumn("is_priority", F.col("page_id") % 5 == 0).cache()
    odd = F.col("page_id") % 2 == 1
    for state, merge in ((A.page_states, A.merged_page_states), (A.code_states, A.merged_code_states)):
        whole, parts = state(pages), merge(state(pages.where(odd)).unionByName(state(pages.where(~odd))))
        assert sorted(map(str, whole.select(*parts.columns).collect())) == sorted(map(str, parts.collect()))
    scores = A.health_score(A.page_states(pages))
    assert scores.count() == 3


def test_a_crawl_that_breaks_off_is_invisible(spark, tmp_path):
    store = AuditStore(spark, str(tmp_path), buckets=2)
    store.crawl(fetches(spark, _crawl(20)), _audit)

    def broken(pages):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.crawl(fetches(spark, _crawl(40)), broken)
    assert len(store.crawls()) == 1 and store.audited().count() == 20 and store.facts().count() == 20


def test_denied_pages_have_an_address_only(spark):
    pages = page_facts(fetches(spark, [fetch(1, "https://a.com/1", _html("x"), headers={"server": "n"}, chain=[("u", 301)]), fetch(2, "https://a.com/2", _html("x"))]))
    verdicts = spark.createDataFrame([(1, True)], "page_id long, is_blocked boolean")
    out = {r["page_id"]: r for r in without_blocked(pages, verdicts).collect()}
    denied = out[1].asDict()
    assert (denied.pop("url"), denied.pop("error"), denied.pop("site"), denied.pop("is_blocked")) == ("https://a.com/1", "Bloqueado por robots.txt", "example.com", True)
    assert denied.pop("page_id") == 1 and denied.pop("depth") == 0 and not any(denied.values())
    assert out[2]["title"] == "x" and out[2]["outlinks"] and not out[2]["is_blocked"]
    audited = rules.collect_page_issues(without_blocked(pages, verdicts).withColumn("is_orphan", F.lit(True)))
    assert [i["code"] for i in audited.where("page_id = 1").first()["issues"]] == ["blocked_by_robots", "orphan_page"]
