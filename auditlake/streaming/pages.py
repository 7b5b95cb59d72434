"""Live feeds: page upserts, running counters, throttling, frontier state and answer analysis.

Every job is restartable from its checkpoint.  What adds up (upserts, counters, pauses of hosts) is an aggregate of a
micro-batch kept in a change table (``streaming/changes.py``) and needs no state.  What depends on order or silence
(notices, frontiers) is a stateful processor with event-time timers on an ordered store.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from auditlake.functions import text as X

# The Python functions below travel inside the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_changes(changes: DataFrame, path: str, checkpoint: str):
    """Starts the job that appends changed rows of a keyed stream (update mode), one partition per batch."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest_rows(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of each key of a change table."""
    changes = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row"))
    return newest.select(*keys, "row.*")


def running_counts(pages: DataFrame, delay: str | None = None) -> DataFrame:
    """Dashboard counters per site; with ``delay`` they are per site and hour behind a watermark on ``ts``,
    which bounds the state of an endless feed."""
    keys = [F.col("site")]
    if delay:
        pages = pages.withWatermark("ts", delay)
        keys.append(F.window("ts", "1 hour").getField("start").alias("hour"))
    failed = F.col("status").isNull() | (F.col("status") >= 400)
    return pages.groupBy(*keys).agg(
        F.count("*").alias("pages"), F.count_if(failed).alias("error_pages"), F.count_if(~failed).alias("ok_pages")
    )


def estimated_total(visited: Column, sitemap_total: Column, max_pages: int = 500) -> Column:
    """Best guess of a crawl's size: the sitemap, growing with what is found, never beyond the page limit."""
    base = F.when(sitemap_total > 0, sitemap_total).otherwise(F.lit(max_pages))
    return F.least(F.lit(max_pages), F.greatest(base, visited))


THROTTLE_STATUS = [429, 502, 503, 504]  # fixed values: answers that ask for patience
NOTICE_GAP = 3.0  # fixed value: seconds between two notices about one host


def throttle_events(log: DataFrame) -> DataFrame:
    """Fetch-log rows that throttle their host, with the delay each one asks for."""
    delay = X.retry_delay(F.col("retry_after"), F.lit(0))
    return log.where(F.col("status").isin(THROTTLE_STATUS)).withColumn("delay", delay)


def backoff_until(log: DataFrame) -> DataFrame:
    """End of each host's pause: the furthest request so far, never shortened.  Combined map-side."""
    return throttle_events(log).groupBy("host").agg(
        F.max(F.col("unix_ts") + F.col("delay")).alias("backoff_until"), F.count("*").alias("throttles")
    )


SPAN_MS = 3600 * 1000  # moments of one host that are kept, and told, together
HELD = 1 << 18  # distinct moments of a micro-batch that a task gathers before it stores them


class _Notices(StatefulProcessor):
    """A host's throttled moments by hour, each hour sorted and without repetition, with one timer at its first moment.

    The store keeps the timers in time order; a task holds one hour at a time, and what is done for each moment stays
    inside the task.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "told double")
        self.spans = handle.getMapState("spans", "span long", "moments array<long>")

    def _store(self, fresh: dict[int, set[int]]) -> None:
        for span, moments in fresh.items():
            known = self.spans.getValue((span,))[0] if self.spans.containsKey((span,)) else []
            first = min(moments)
            if not known or first < known[0]:
                if known:
                    self.handle.deleteTimer(known[0] - 1)
                # one millisecond early, so that the newest moment of the feed is behind the watermark too
                self.handle.registerTimer(first - 1)
            self.spans.updateValue((span,), (sorted(moments.union(known)),))
        fresh.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        fresh, held = {}, 0
        for row in rows:
            moment = int(row["unix_ts"] * 1000)
            span = fresh.setdefault(moment // SPAN_MS, set())
            if moment not in span:
                span.add(moment)
                held += 1
            if held == HELD:
                self._store(fresh)
                held = 0
        self._store(fresh)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        first = expiredTimerInfo.getExpiryTimeInMs() + 1
        span = first // SPAN_MS
        moments = self.spans.getValue((span,))[0]
        passed = bisect_right(moments, max(first, timerValues.getCurrentWatermarkInMs()))
        told = self.last.get()[0] if self.last.exists() else None
        for moment in (m / 1000 for m in moments[:passed]):
            if told is None or moment - told > NOTICE_GAP:
                told = moment
                yield Row(host=key[0], notified_at=moment)
        self.last.update((told,))
        if passed < len(moments):
            self.spans.updateValue((span,), (moments[passed:],))
            self.handle.registerTimer(moments[passed] - 1)
        else:
            self.spans.removeKey((span,))

    def close(self) -> None:
        """Nothing is held."""


def backoff_notices(log: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """At most one notice per host and three seconds, in the order of ``unix_ts`` (to the millisecond).

    A notice goes out when the watermark has passed its moment: rows that come up to ``delay`` late take their place, later
    ones are dropped, and a feed that stands still keeps the notices of its last ``delay`` to itself.  Without delay only
    the rows of one micro-batch are brought into order.  A host of any size keeps its moments in the store.
    """
    timed = log.withColumn("_at", F.timestamp_micros((F.col("unix_ts") * 1000000).cast("long"))).withWatermark("_at", delay)
    moments = throttle_events(timed).select("host", F.col("unix_ts").cast("double").alias("unix_ts"))
    return moments.groupBy("host").transformWithState(_Notices(), "host string, notified_at double", "append", "eventTime")


EXPIRY_MS = 7 * 24 * 3600 * 1000


class _Frontier(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.work = handle.getValueState("work", "pending long, saved_at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        known = self.work.get() if self.work.exists() else None
        pending, saved_at = known or (0, 0)
        if known:
            self.handle.deleteTimer(saved_at + EXPIRY_MS)
        for row in rows:
            pending += row["added"] - row["taken"]
            saved_at = max(saved_at, row["unix_ms"])
        self.work.update((pending, saved_at))
        self.handle.registerTimer(saved_at + EXPIRY_MS)
        yield Row(seed_url=key[0], pending=pending, saved_at=saved_at, expired=False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        pending, saved_at = self.work.get()
        self.work.clear()
        yield Row(seed_url=key[0], pending=pending, saved_at=saved_at, expired=True)

    def close(self) -> None:
        """Nothing is held."""


def frontier_state(changes: DataFrame) -> DataFrame:
    """Pending work per crawl; a crawl that stays silent for seven days is reported as expired and leaves the state.

    ``changes``: seed_url, ts (timestamp), unix_ms, added, taken.  Time is event time: a crawl expires when the watermark,
    one hour behind the newest change of any crawl, passes its last change by seven days.
    """
    return (
        changes.withWatermark("ts", "1 hour").groupBy("seed_url")
        .transformWithState(_Frontier(), "seed_url string, pending long, saved_at long, expired boolean", "update", "eventTime")
    )


@contextmanager
def ordered_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which timers need; those of the session before are untouched."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def append_stream(rows: DataFrame, path: str, checkpoint: str):
    """Starts a stateless job with an exactly-once file sink."""
    return (
        rows.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
