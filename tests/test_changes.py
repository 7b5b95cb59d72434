"""Change tables and timers: bounded files, replays, expiry and order."""

import os

from pyspark.sql import functions as F

from auditlake.streaming import changes as C, pages as S
from helpers import values


def _files(folder):
    return [f for _, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]


def test_fifty_batches_leave_a_bounded_table(spark, tmp_path):
    table = C.ChangeTable(spark, str(tmp_path / "t"), C.totals(["site"], ["pages"], ["seen"]), every=5)
    want, most = {}, 0
    for batch in range(50):
        rows = [(f"s{batch % 3}", 1, batch), ("hot", 2, batch)]
        for site, n, _ in rows:
            want[site] = want.get(site, 0) + n
        table.put(spark.createDataFrame(rows, "site string, pages long, seen long").coalesce(1), batch)
        most = max(most, len(os.listdir(tmp_path / "t" / "batches")))
    assert most <= 10 and len(table.bases.versions()) == 2
    assert len(_files(tmp_path / "t")) < 40
    assert dict(values(table.read(), "site", "pages")) == want
    assert dict(values(table.read(), "site", "seen"))["hot"] == 49
    # the last batch again, held by a base or not, changes nothing
    table.put(spark.createDataFrame([("hot", 2, 49)], "site string, pages long, seen long"), 49)
    table.put(spark.createDataFrame([("hot", 7, 50)], "site string, pages long, seen long"), 50)
    table.put(spark.createDataFrame([("hot", 7, 50)], "site string, pages long, seen long"), 50)
    assert dict(values(table.read(), "site", "pages")) == {**want, "hot": want["hot"] + 7}


def test_half_written_batch_and_base_are_invisible(spark, tmp_path):
    table = C.ChangeTable(spark, str(tmp_path / "t"), C.latest(["k"], "v"), every=100)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v long, x string")
    table.put(rows(("a", 1, "old"), ("b", 1, "b"), (None, 1, None)), 0)
    table.put(rows(("a", 2, "new"), ("a", 2, "newer"), ("b", 0, "late")), 1)
    rows(("a", 9, "lost")).write.parquet(str(tmp_path / "t" / "batches" / "2"))
    os.remove(tmp_path / "t" / "batches" / "2" / "_SUCCESS")
    rows(("a", 9, "lost")).write.parquet(str(tmp_path / "t" / "bases" / "data-lost"))
    want = {("a", 2, "newer"), ("b", 1, "b"), (None, 1, None)}
    assert set(values(table.read(), "k", "v", "x")) == want
    table.compact(1)
    assert set(values(table.read(), "k", "v", "x")) == want and not os.path.exists(tmp_path / "t" / "bases" / "data-lost")


def test_old_keys_expire(spark, tmp_path):
    table = C.ChangeTable(spark, str(tmp_path / "t"), C.totals(["k"], ["n"], ["at"]), every=2, expiry=("at", 10))
    for batch, (key, at) in enumerate([("a", 0), ("b", 5), ("c", 10), ("d", 15), ("e", None), ("f", 15)]):
        table.put(spark.createDataFrame([(key, 1, at)], "k string, n long, at long"), batch)
        if batch == 2:
            assert {k for (k,) in values(table.read(), "k")} == {"a", "b", "c"}
    assert {k for (k,) in values(table.read(), "k")} == {"b", "c", "d", "e", "f"}
    assert {k for (k,) in values(table.bases.read(), "k")} == {"b", "c", "d", "e", "f"}


def test_upserts_follow_a_stream_over_restarts(spark, tmp_path):
    schema = "url string, seq long, status int"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = C.ChangeTable(spark, str(tmp_path / "t"), C.latest(["url"], "seq"), every=3)
    want = {}
    for run in range(2):
        for i in range(4):
            seq = 10 * run + i
            spark.createDataFrame([("/a", seq, 200 + i), (f"/{i}", -seq, 404)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            want["/a"] = (seq, 200 + i)
            want[f"/{i}"] = max(want.get(f"/{i}", (-99, 404)), (-seq, 404))
        table.follow(stream, str(tmp_path / "cp")).awaitTermination()
        assert {u: (v, s) for u, v, s in values(table.read(), "url", "seq", "status")} == want


def test_a_silent_crawl_expires_when_the_clock_moves(spark, tmp_path):
    schema = "seed_url string, unix_ms long, added long, taken long"
    day = 24 * 3600 * 1000
    states = C.ChangeTable(spark, str(tmp_path / "t"), C.latest(["seed_url"], "batch_no"))

    def run(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis("unix_ms"))
        with S.ordered_store(spark):
            S.frontier_state(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(
                lambda batch, number: states.put(batch.withColumn("batch_no", F.lit(number)), number)).start().awaitTermination()
        return {r["seed_url"]: (r["pending"], r["expired"]) for r in states.read().collect()}

    assert run(("silent", day, 5, 1), ("busy", day, 3, 0), ("busy", day, 0, 1)) == {"silent": (4, False), "busy": (2, False)}
    assert run(("busy", 5 * day, 2, 0)) == {"silent": (4, False), "busy": (4, False)}
    assert run(("busy", 9 * day, 0, 1)) == {"silent": (4, True), "busy": (3, False)}
    assert run(("silent", 9 * day, 7, 0)) == {"silent": (7, False), "busy": (3, False)}  # starts afresh


def test_notices_of_a_hot_host_come_in_order_over_batches(spark, tmp_path):
    schema = "host string, unix_ts double, status int, retry_after string"
    steps = [0.5 * i + (i % 7) * 0.125 for i in range(400)]
    for part in range(4):
        rows = [("hot", t, 429, "1") for t in reversed(steps[part * 100:(part + 1) * 100])] + [(f"h{part}", steps[part * 100] + 1, 503, None), ("calm", steps[part * 100 + 5], 200, None)]
        spark.createDataFrame(rows + rows[:3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with S.ordered_store(spark):
        S.append_stream(S.backoff_notices(stream, "1 minute"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.schema("host string, notified_at double").parquet(str(tmp_path / "out"))
    newest, want, last = max(steps), [], float("-inf")
    for t in sorted(steps):
        if t - last > S.NOTICE_GAP and t <= newest - 60:
            want.append(t)
            last = t
    assert sorted(t for h, t in values(got, "host", "notified_at") if h == "hot") == want
    assert {h for h, _ in values(got, "host", "notified_at")} == {"hot", "h0", "h1", "h2"}
