import json

from pyspark.sql import functions as F

from auditlake.functions import text as X
from auditlake.operators import brand as B, history, render
from auditlake.sources import readers, sinks
from auditlake.streaming import pages as S
from helpers import one, values


def test_diff(spark):
    schema = "site string, crawl_ts long, url string, codes array<string>"
    old = [("s", 1, "/a", ["x", "y"]), ("s", 1, "/b", []), ("s", 1, "/gone", ["z"])]
    new = [("s", 2, "/a", ["y"]), ("s", 2, "/b", ["w"]), ("s", 2, "/c", [])]
    got = {r.url: (r.new_codes, r.resolved_codes, r.page_added, r.page_removed) for r in history.consecutive_diffs(spark.createDataFrame(old + new, schema)).collect()}
    assert got == {"/a": ([], ["x"], False, False), "/b": (["w"], [], False, False), "/gone": ([], ["z"], False, True), "/c": ([], [], True, False)}
    keys = ["site", "url"]
    a, b = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    forth, back = history.diff(a, b, keys), history.diff(b, a, keys)
    assert sorted(values(forth, "url", "new_codes", "page_added")) == sorted(values(back, "url", "resolved_codes", "page_removed"))
    summary = history.diff_summary(history.consecutive_diffs(spark.createDataFrame(old + new, schema))).collect()[0]
    assert (summary.new_issue_count, summary.resolved_issue_count, summary.new_pages, summary.removed_pages, summary.is_empty) == (1, 2, 1, 1, False)


def test_previous_snapshot_is_strictly_before(spark):
    pages = spark.createDataFrame([("s", t) for t in (10, 20, 30)], "site string, crawl_ts long")
    asked = spark.createDataFrame([("s", t) for t in (5, 10, 11, 30, 99)], "site string, before_ts long")
    assert dict(values(history.previous_snapshot(asked, pages), "before_ts", "previous_ts")) == {5: None, 10: None, 11: 10, 30: 20, 99: 30}


BRANDS = [B.Brand("Acme", "acme.com", ("Acmé Corp",), True), B.Brand("Rival"), B.Brand("Más")]


def test_mentions_and_stats(spark):
    answers = spark.createDataFrame([
        (1, "p", "i", True, "Rival y luego ACME (acme.com)", ""), (2, "p", "i", True, "acmeland no cuenta", ""), (3, "p", "j", False, "mas, acme corp", ""), (4, "p", "j", False, "", "HTTP 500"),
    ], "resp_id long, provider string, intent string, web_search boolean, text string, error string")
    found = B.with_mentions(answers, BRANDS)
    got = {r.resp_id: [(m.brand, m.position, m.is_domain_citation) for m in r.mentions] for r in found.collect()}
    assert got == {1: [("Rival", 1, False), ("Acme", 2, True)], 2: [], 3: [("Más", 1, False), ("Acme", 2, False)], 4: []}
    stats = {r.brand: r for r in B.brand_stats(found, BRANDS, [[]]).collect()}
    assert stats["Acme"].mention_rate == 0.5 and stats["Acme"].avg_position == 2.0 and stats["Acme"].share_of_voice == 0.5
    assert stats["Acme"].domain_citation_rate == 0.5 and stats["Rival"].domain_citation_rate == 0.0
    by_intent = {(r.intent, r.brand): r for r in B.brand_stats(found, BRANDS, [["intent"]]).collect()}
    assert by_intent[("j", "Acme")].domain_citation_rate is None and by_intent[("j", "Más")].mention_rate == 0.5


def test_battery_parsing(spark):
    replies = [(1, '```json\n{"comparativa": [" a ", "", "b", "c"]}\n```'), (2, 'Claro: {"comparativa": ["x"], "otra": ["y"]} listo'), (3, "sin json"), (4, '{"comparativa": ["x"]} }')]
    df = spark.createDataFrame(replies, "doc_id long, reply string")
    got = sorted(values(B.parse_battery(df, ["comparativa", "transaccional"], 3), "doc_id", "intent", "text"))
    assert got == [(1, "comparativa", "a"), (1, "comparativa", "b"), (2, "comparativa", "x")]


def test_text_functions(spark):
    assert one(spark, X.fold, "ÑANDÚ Café é") == "nandu cafe e"
    assert one(spark, X.framing_label, "  Con_Reservas.") == "con_reservas" and one(spark, X.framing_label, "?") == "neutro"
    assert one(spark, X.is_relevant, "Novedades de SEO") and not one(spark, X.is_relevant, "Yoon-seo actriz") and one(spark, X.is_relevant, "La Búsqueda con IA")
    for text, kind in {"net::ERR_NAME_NOT_RESOLVED": "dns_not_found", "TLS handshake timed out": "timeout", "ERR_CONNECTION_REFUSED": "connection_refused", "ERR_CERT_DATE_INVALID": "ssl_error", "?": "connection_error"}.items():
        assert one(spark, X.fetch_error_class, text) == kind
    for age, caption in {-5: "hace un momento", 10: "hace 1 min", 125: "hace 2 min", 3600: "hace 1 hora", 7300: "hace 2 horas", 90000: "hace 1 día", 200000: "hace 2 días"}.items():
        assert one(spark, X.relative_time, age) == caption
    delay = lambda a, n: one(spark, X.retry_delay, a, n)
    assert delay("7", 3) == 7.0 and delay("-2", 0) == 0.0 and delay("x", 1) == 3.0 and delay("", 9) == 20.0
    stamp = one(spark, X.rfc822_timestamp, "Mon, 15 Jan 2024 10:00:00 GMT")
    assert str(stamp) == "2024-01-15 10:00:00"


def test_snapshot_and_run_files(spark, tmp_path):
    (tmp_path / "h").mkdir()
    page = {"url": "/a", "status_code": 200, "issues": [["meta", "info", "thin_content", "m"]], "redirect_chain": [["/x", 301]], "h1": ["t"]}
    (tmp_path / "h" / "1.json").write_text(json.dumps({"seed_url": "https://x.com/", "timestamp": 5.5, "pages": {"/a": ["thin_content"]}, "status_by_url": {"/a": 200}, "site_issues": [], "pages_full": [page]}))
    (tmp_path / "h" / "2.json").write_text(json.dumps({"seed_url": "https://x.com/", "timestamp": 4.5, "pages": {"/a": [], "/b": []}, "status_by_url": {"/a": None}}))
    (tmp_path / "h" / "3.json").write_text("{broken")
    snaps = readers.read_snapshots(spark, str(tmp_path / "h"))
    assert values(readers.snapshot_catalog(snaps), "crawl_ts", "page_count", "has_full") == [(5.5, 1, True), (4.5, 2, False)]
    full = readers.full_pages(snaps).collect()[0]
    assert full.issues[0].code == "thin_content" and full.redirect_chain[0].status == 301
    run = {"created_at": 1.0, "config": {"target": {"name": "Acme"}}, "analyses": [{"response": {"provider": "p", "text": "t"}, "mentions": [{"brand": "Acme", "position": 1, "is_domain_citation": False}], "framing": {}}]}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1.json").write_text(json.dumps(run, indent=2))
    assert readers.read_brand_runs(spark, str(tmp_path / "r")).collect()[0].mentions[0].brand == "Acme"
    sinks.write_csv(snaps.select("seed_url"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_streams(spark, tmp_path):
    rows = [(f"h{i % 2}", float(100 + i // 3), 429 if i % 4 else 200, "2") for i in range(60)]
    schema = "host string, unix_ts double, status int, retry_after string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    with S.ordered_store(spark):
        S.append_stream(S.backoff_notices(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = set()
    for host in ("h0", "h1"):
        last = float("-inf")
        for t in sorted(r[1] for r in rows if r[0] == host and r[2] == 429):
            if t - last > 3:
                want.add((host, t))
                last = t
    assert set(values(spark.read.parquet(str(tmp_path / "out")), "host", "notified_at")) == want
    S.write_changes(S.backoff_until(stream), str(tmp_path / "b"), str(tmp_path / "bcp")).awaitTermination()
    latest = S.latest_rows(spark, str(tmp_path / "b"), ["host"])
    assert dict(values(latest, "host", "backoff_until")) == {h: max(r[1] for r in rows if r[0] == h and r[2] == 429) + 2 for h in ("h0", "h1")}
    hourly = S.running_counts(spark.createDataFrame([("s", None, 200)], "site string, ts timestamp, status int"), "10 minutes")
    assert "hour" in hourly.columns
    assert one(spark, lambda v, s: S.estimated_total(v, s, 500), 7, 0) == 500 and one(spark, lambda v, s: S.estimated_total(v, s, 500), 70, 60) == 70


def test_tone_belongs_to_a_brand(spark):
    replies = [(1, "Acme", "Positivo."), (1, "Rival", "negativo"), (2, "Acme", "NEGATIVO"), (2, "Acme", "NEGATIVO"), (3, "Rival", "Positivo"), (3, None, "x")]
    tones = B.tones_by_brand(spark.createDataFrame(replies, "resp_id long, brand string, reply string"))
    both = [("Acme", 1, False), ("Rival", 2, False)]
    answers = spark.createDataFrame([(1, both, False), (2, both, False), (3, both[:1], False), (4, both, False)], "resp_id long, mentions array<struct<brand:string,position:int,is_domain_citation:boolean>>, web_search boolean")
    stats = {r["brand"]: r for r in B.brand_stats(answers.join(tones, "resp_id", "left"), [B.Brand("Acme"), B.Brand("Rival")], [[]]).collect()}
    assert (stats["Acme"]["framing_positivo"], stats["Acme"]["framing_negativo"]) == (0.5, 0.5)  # answers 1 and 2; 3 has no tone for it
    assert (stats["Rival"]["framing_positivo"], stats["Rival"]["framing_negativo"]) == (0.0, 1.0)  # answer 3 doesn't name it


def test_runs_are_listed_in_time_order(spark, tmp_path):
    from auditlake.sources import readers, sinks
    from auditlake.sources.versions import VersionedTable

    runs = VersionedTable(spark, str(tmp_path / "runs"))
    rows = lambda x: spark.createDataFrame([(x,)], "text string")
    for text, brand, at in (("b", "Acme", 20), ("a", "Acme", 10), ("c", "Otra", 15)):
        sinks.save_brand_run(rows(text), runs, brand, at)
    assert [(r["brand"], r["run_ts"]) for r in readers.list_runs(runs)] == [("Acme", 10), ("Otra", 15), ("Acme", 20)]
    mine = readers.list_runs(runs, "Acme")
    assert [runs.read(r["version"]).first()["text"] for r in mine] == ["a", "b"]


def test_sinks_are_read_back(spark, tmp_path):
    from auditlake.sources import sinks
    from auditlake.sources.versions import VersionedTable

    pages = spark.createDataFrame([("s", "/a", 200, [("b",), ("a",), ("b",)])], "site string, url string, status int, issues array<struct<code:string>>")
    crawls = VersionedTable(spark, str(tmp_path / "crawls"))
    assert sinks.save_crawl(pages, crawls, "https://s/", 7) == 1
    assert crawls.read().first()["codes"] == ["a", "b"] and crawls.versions()[0]["info"]["crawl_ts"] == 7
    reports = VersionedTable(spark, str(tmp_path / "reports"))
    sinks.write_area_reports(spark.createDataFrame([("s", "meta", 1), ("s", "links", 2)], "site string, category string, row_no int"), reports)
    assert reports.read().count() == 2 and reports.read(buckets=["meta"]).collect()[0]["row_no"] == 1
    frontiers = VersionedTable(spark, str(tmp_path / "frontier"))
    sinks.save_frontier(spark.createDataFrame([("u",)], "url string"), frontiers, 1)
    frontiers.clear()
    assert frontiers.record() is None
