"""Sorted grids: rows ranged by one column, so that any page of the sorted order is read from the ranges it lies in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from auditlake.sources.versions import VersionedTable


class SortedGrid:
    """The rows of a table in the order of one column, ties by ``tie`` (unique, always ascending), in a folder of its own.

    Bounds of the ranges are sampled by column and tie, so a value that many rows share is split as well.  The number of
    rows of every range (as many as shuffle partitions) is all a reader needs to find a page.  Nulls come first, or last
    in descending order.
    """

    def __init__(self, spark: SparkSession, folder: str, column: str, tie: str, descending: bool = False):
        self.spark, self.store = spark, VersionedTable(spark, folder)
        name = f"`{column}`"
        self.order: list[Column] = [F.desc_nulls_last(name) if descending else F.asc_nulls_first(name), F.asc(f"`{tie}`")]

    def save(self, rows: DataFrame) -> int:
        """Stores the order.  ``rows`` should be a stored table: sampling the bounds reads it once more."""
        ranges = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = rows.repartitionByRange(ranges, *self.order).withColumn("_range_no", F.spark_partition_id())
        return self.store.write(ranged.withColumn("_range", F.col("_range_no")), "_range")

    def _starts(self) -> list[tuple[int, int, int]]:
        """Ranges that have rows, in order: number, rows before it, rows in it."""
        sizes = self.store.read().groupBy("_range_no").count().collect()
        out, before = [], 0
        for r in sorted(sizes):
            out.append((r["_range_no"], before, r["count"]))
            before += r["count"]
        return out

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 0) of the order; reads and sorts the ranges it touches only."""
        first, last = number * size, (number + 1) * size
        touched = [(n, before) for n, before, rows in self._starts() if before < last and before + rows > first]
        if not touched:
            return self.store.read().drop("_range_no").limit(0)
        rows = self.store.read(buckets=[n for n, _ in touched]).orderBy(*self.order)
        return rows.offset(first - touched[0][1]).limit(size).drop("_range_no")

    def positions(self, name: str = "position") -> DataFrame:
        """All rows with their place in the order, from 1: numbered range by range."""
        starts = self.spark.createDataFrame([(n, before) for n, before, _ in self._starts()], "_range_no int, _ahead long")
        local = F.row_number().over(W.partitionBy("_range_no").orderBy(*self.order))
        numbered = self.store.read().withColumn("_local", local).join(F.broadcast(starts), "_range_no")
        return numbered.withColumn(name, F.col("_local") + F.col("_ahead")).drop("_range_no", "_local", "_ahead")
