"""Change tables: running results of endless feeds, without streaming state and with a bounded number of files.

A micro-batch is reduced to one partial row per key and written as one folder.  Partial rows add up: ``merge`` of merged
rows equals ``merge`` of all rows, so nothing needs to be remembered between batches.  Every ``every`` batches the folders
are merged into a base, a version of its own that becomes visible at once (``sources/versions.py``); folders that a base
holds are never read again and go with the next base.  A reader therefore merges a base and at most ``every`` folders.

A batch that is replayed after a lost executor or driver overwrites its own folder, or is left out if a base holds it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditlake.sources.versions import VersionedTable


class ChangeTable:
    """``merge`` maps rows to one row per key and must accept its own result.

    ``expiry`` names an event-time column (any ordered number) and an age: keys whose value lies further than that behind
    the newest one are not returned, and leave the table with the next base.  A key that comes back later starts afresh.
    """

    def __init__(self, spark: SparkSession, folder: str, merge: Callable[[DataFrame], DataFrame], every: int = 20, expiry: tuple[str, float] | None = None):
        self.spark, self.folder, self.merge, self.every, self.expiry = spark, folder, merge, every, expiry
        self.bases = VersionedTable(spark, f"{folder}/bases")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _batches(self) -> list[int]:
        path = self._path(f"{self.folder}/batches")
        names = [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []
        done = [n for n in names if self._fs.exists(self._path(f"{self.folder}/batches/{n}/_SUCCESS"))]
        return sorted(int(n) for n in done if n.isdigit())

    def _through(self) -> int:
        """Last batch that the newest base holds."""
        return (self.bases.record() or {"info": {"through": -1}})["info"]["through"]

    def put(self, rows: DataFrame, batch: int) -> None:
        """Adds the rows of one micro-batch; to be called from ``foreachBatch``."""
        if batch <= self._through():
            return
        self.merge(rows).write.mode("overwrite").parquet(f"{self.folder}/batches/{batch}")
        if (batch + 1) % self.every == 0:
            self.compact(batch)

    def compact(self, through: int) -> None:
        """Merges everything up to a batch into a new base and removes what the base before it already held."""
        held = self._through()
        self.bases.write(self._merged(through), info={"through": through})
        self.bases.clear(keep=2)  # readers that have just opened the base before keep their files
        for batch in self._batches():
            if batch <= held:
                self._fs.delete(self._path(f"{self.folder}/batches/{batch}"), True)

    def _merged(self, through: int | None = None) -> DataFrame:
        held = self._through()
        parts = [self.bases.read()] if held >= 0 else []
        recent = [b for b in self._batches() if b > held and (through is None or b <= through)]
        if recent:
            parts.append(self.spark.read.parquet(*[f"{self.folder}/batches/{b}" for b in recent]))
        if not parts:
            raise LookupError(f"no batch was written to {self.folder}")
        rows = self.merge(reduce(DataFrame.unionByName, parts))
        if self.expiry is None:
            return rows
        column, age = self.expiry
        newest = reduce(DataFrame.unionByName, [p.agg(F.max(column).alias("_newest")) for p in parts]).agg(F.max("_newest")).scalar()
        return rows.where(F.col(column).isNull() | (F.col(column) >= newest - F.lit(age)))

    def read(self) -> DataFrame:
        """One row per key: all batches so far."""
        return self._merged()

    def follow(self, rows: DataFrame, checkpoint: str, output_mode: str = "append"):
        """Starts the job that keeps this table; it runs to the end of what is there and may be started again."""
        return rows.writeStream.outputMode(output_mode).foreachBatch(self.put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(keys: list[str], version: str) -> Callable[[DataFrame], DataFrame]:
    """Merge that keeps each key's row of the highest ``version``; among equals the greatest row."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, version)]
        return rows.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_row")).select(*keys, "_row.*")

    return merge


def totals(keys: list[str], sums: list[str], maxima: list[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """Merge that adds up ``sums`` and keeps the greatest of ``maxima``."""

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima])

    return merge
