"""Versioned tables: every write is a new version that becomes visible at once, when its commit record is there.

A table is a folder with data folders and commit records (``_versions/<number>.json``).  A record is written after its
data and names every part that belongs to the version, so a run that stops half-way leaves data that nobody reads.  A
write may replace some buckets only; the record then names the earlier parts of all others, which stay where they are.

Records are created without overwriting: of two writers of one version the second takes the next number.  On stores whose
create is not exclusive let one job write a table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names(f"{self.folder}/_versions") if n.endswith(".json")]

    def record(self, version: int | None = None) -> dict | None:
        """Commit record of a version, by default the newest; None if there is none."""
        numbers = self._numbers()
        if not numbers or version not in (None, *numbers):
            return None
        stream = self._fs.open(self._path(f"{self.folder}/_versions/{max(numbers) if version is None else version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def versions(self) -> list[dict]:
        """All commit records, oldest first."""
        return [self.record(n) for n in self._numbers()]

    def commit(self, record: dict) -> int:
        """Makes a record visible under the next free number."""
        number = max(self._numbers(), default=0) + 1
        while True:
            target = self._path(f"{self.folder}/_versions/{number:012d}.json")
            try:
                stream = self._fs.create(target, False)
            except Exception as taken:
                if not self._fs.exists(target):
                    raise taken
                number += 1
                continue
            stream.write(bytearray(json.dumps({**record, "version": number}).encode()))
            stream.close()
            return number

    def write(self, df: DataFrame, bucket: str | None = None, info: dict | None = None) -> int:
        """Writes ``df`` as a new version.  With ``bucket``, a column of whole numbers, only the buckets of ``df`` are replaced."""
        name = f"data-{uuid.uuid4().hex}"
        target, before = f"{self.folder}/{name}", self.record() or {}
        if bucket is None:
            df.write.parquet(target)
            parts = {"": name}
        else:
            df.write.partitionBy(bucket).parquet(target)
            new = {n.split("=", 1)[1]: f"{name}/{n}" for n in self._names(target) if n.startswith(f"{bucket}=")}
            parts = {**{b: p for b, p in before.get("parts", {}).items() if b}, **new}
        schema = df.drop(bucket).schema if bucket else df.schema
        return self.commit({"parts": parts, "schema": schema.jsonValue(), "info": info or {}})

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, by default the newest complete one; ``buckets`` reads those only."""
        record = self.record(version)
        if record is None:
            raise LookupError(f"no {'complete' if version is None else 'such'} version in {self.folder}")
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.folder}/{p}" for b, p in sorted(record["parts"].items()) if wanted is None or b in wanted]
        schema = StructType.fromJson(record["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def clear(self, keep: int = 0) -> None:
        """Removes all but the newest ``keep`` versions and everything that no version names, half-written data included."""
        numbers = self._numbers()
        stay = numbers[len(numbers) - keep :] if keep else []
        for number in set(numbers) - set(stay):
            self._fs.delete(self._path(f"{self.folder}/_versions/{number:012d}.json"), False)
        named = {p for n in stay for p in self.record(n).get("parts", {}).values()}
        for name in self._names(self.folder):
            if name.startswith("data-") and name not in named:
                held = {p.split("/")[1] for p in named if p.startswith(f"{name}/")}
                if not held:
                    self._fs.delete(self._path(f"{self.folder}/{name}"), True)
                else:
                    for part in self._names(f"{self.folder}/{name}"):
                        if "=" in part and part not in held:
                            self._fs.delete(self._path(f"{self.folder}/{name}/{part}"), True)
