"""Inputs in other shapes and sizes: tables in many files, work that must not grow faster than the input."""

import duckdb
import pytest
from pyspark.sql import functions as F

from auditlake.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, table", [("stream_mentions", "documents"), ("stream_counts", "events")])
def test_streams_read_tables_of_many_files(spark, tmp_path, name, table):
    """A table may be a folder of part files; its neighbours in the input folder are left alone."""
    whole = spark.read.parquet(f"{SF}/{table}.parquet")
    whole.repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    whole.limit(5).write.parquet(f"{tmp_path}/{table}.parquet.old")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(want.fetchall())


def test_stream_without_rows_gives_none(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["stream_mentions"](spark, str(tmp_path)).collect() == []


def test_notices_cost_one_timer_an_hour(monkeypatch):
    """A host's moments are stored and told by hour: what goes through the state store does not grow with every moment."""
    from auditlake.streaming import pages as S

    calls = []

    class Value:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Map(dict):
        containsKey, getValue, removeKey, updateValue = dict.__contains__, dict.get, dict.pop, dict.__setitem__

    class Handle:
        timers = set()

        def getValueState(self, *_):
            return Value()

        def getMapState(self, *_):
            return Map()

        def registerTimer(self, at):
            calls.append("timer")
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.discard(at)

    class Now:
        def __init__(self, at):
            self.at = at

        getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.at

    monkeypatch.setattr(S, "HELD", 100)
    processor, handle, told = S._Notices(), Handle(), []
    processor.init(handle)
    assert list(processor.handleInputRows(("h",), iter([{"unix_ts": float(t)} for t in reversed(range(4000, 6000))] * 2), Now(0))) == []
    assert len(handle.timers) == 1 and len(calls) <= 25
    for watermark in (5000 * 1000, 9000 * 1000):
        due = min(handle.timers)
        handle.timers.discard(due)
        told += [r.notified_at for r in processor.handleExpiredTimer(("h",), Now(watermark), Now(due))]
    assert told == [float(t) for t in range(4000, 6000, 4)] and not handle.timers and len(calls) <= 30


def test_brand_runs_share_files(spark, tmp_path, monkeypatch):
    """Sixteen answers are a document, but a document is no file: their number must not grow with the answers."""
    import glob

    from auditlake.plans import sources_sinks

    monkeypatch.setattr(sources_sinks, "_folder", lambda spark, name: f"{tmp_path}/{name}")
    rows = QUERIES["brand_runs_load"](spark, SF)
    runs = rows.select("created_at").distinct().count()
    files = glob.glob(f"{tmp_path}/brand-runs/**/part-*", recursive=True)
    assert runs > 10 and len(files) <= 8


def test_text_of_a_page_costs_its_length(spark):
    """Blanks of every kind are trimmed as before, and a long run of them within a text is passed once."""
    import time

    from auditlake.functions import html as H
    from helpers import one

    every = [chr(i) for i in range(1, 0x3002) if not 0xD800 <= i < 0xE000]
    blanks = "".join(c for c in every if c.isspace())
    assert one(spark, H.trim_ws, f"{blanks}a{blanks}b{blanks}") == f"a{blanks}b"
    assert one(spark, H.visible_text, f"{blanks}<p>{blanks}a b{blanks}</p>{blanks}<i>{blanks}c") == "a b c"
    assert one(spark, H.word_count, blanks.join("abc")) == 3
    began = time.perf_counter()
    run = " " * 150000
    got = one(spark, H.visible_text, f"<p>a{run}b</p>{run}<p>c</p>")
    assert len(got) == 150004 and time.perf_counter() - began < 20


def test_common_and_rare_names_are_decoded(spark):
    from html import unescape

    from auditlake.functions import html as H
    from helpers import one

    text = "&lt;&ntilde;&nbsp;&zwnj;&Zopf;&hellip;&ThickSpace;&quot;&unknown;&amp;lt;"
    assert one(spark, H.decode_entities, text) == unescape(text.replace("&unknown;", "U")).replace("U", "&unknown;")


def test_a_bucket_is_one_file(spark):
    """Rounds of a walk open every file of the links, so their number must not be tasks times buckets."""
    from auditlake.operators.shuffle import BucketedTables

    for buckets in (None, 3):
        tables = BucketedTables(spark, "files", *[buckets][: buckets is not None])
        stored = tables.put(spark.range(0, 4000, 1, 8), ["id"])
        assert len(stored.inputFiles()) == (buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        assert stored.count() == 4000
        tables.drop()


def test_settled_nodes_meet_what_is_reached_not_all_links(spark):
    from auditlake.operators import links
    from auditlake.operators.shuffle import BucketedTables

    tables, keys = BucketedTables(spark, "late"), ["site", "node"]
    edges = spark.createDataFrame([("a", f"n{i}", f"n{i * k % 50}", k) for i in range(50) for k in range(3)], "site string, node string, dst string, link_pos int")
    hubs = spark.createDataFrame([], "site string, node string, _hub boolean")
    stored = tables.put(links.salted_edges(edges, hubs, keys), [*keys, "_salt"])
    settled = [tables.put(spark.createDataFrame([("a", f"n{i}")], "site string, node string"), keys) for i in (0, 7)]
    level = tables.put(spark.createDataFrame([("a", "n7", 3, [1])], "site string, node string, depth int, place array<long>"), keys)
    out = links.expanded(stored, level, hubs, settled, keys)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan[plan.rindex("Aggregate"):].count("Join") == 2, plan  # the open nodes and their parts
    assert [(r["node"], r["depth"]) for r in out.collect()] == [("n14", 4)]
    tables.drop()


@pytest.mark.parametrize("fan", [3, 400])
def test_walks_with_and_without_a_hub(spark, monkeypatch, fan):
    """One store of the links serves several walks; no round is run without a node to expand."""
    from auditlake.operators import links

    edges = [("a", "n0", f"n{i}", i) for i in range(1, fan + 1)] + [("a", f"n{i}", f"m{i}", 0) for i in range(1, 61)] + [("a", f"m{i}", "n0", 0) for i in range(1, 61)]
    table = spark.createDataFrame(edges, "site string, src string, dst string, link_pos int")
    seed = spark.createDataFrame([("a", "n0", 0, 0)], "site string, node string, depth int, pos int")
    want = {"n0": 0} | {f"n{i}": 1 for i in range(1, fan + 1)} | {f"m{i}": 2 for i in range(1, min(fan, 60) + 1)}
    rounds, expanded = [], links.expanded
    monkeypatch.setattr(links, "expanded", lambda *a: rounds.append(1) or expanded(*a))
    before = {t.name for t in spark.catalog.listTables()}
    with links.StoredLinks(table) as stored:
        assert (stored.hubs is not None) == (fan == 400)
        first = links.bfs(stored, seed, 0)
        assert {r["node"]: r["depth"] for r in first.collect()} == {n: d for n, d in want.items() if d < 2} and len(rounds) == 1
        again = links.bfs(stored, first.where("depth = 1").withColumn("pos", F.element_at("place", -1)), 5, visited=first.where("depth = 0"))
        assert {r["node"]: r["depth"] for r in again.collect()} == {n: d for n, d in want.items() if d > 0}
    assert {t.name for t in spark.catalog.listTables()} == before


def test_a_resumed_crawl_stores_its_links_once(spark, monkeypatch):
    from auditlake.operators.shuffle import BucketedTables

    put, stored = BucketedTables.put, []
    monkeypatch.setattr(BucketedTables, "put", lambda self, df, keys: stored.append("dst" in df.columns) or put(self, df, keys))
    assert QUERIES["bfs_resume"](spark, SF).count() > 100 and sum(stored) == 1
