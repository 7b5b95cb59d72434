"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditlake.operators.shuffle import shared_folder, stage


class Scratch:
    """Intermediate tables of one operator in a folder of their own, deleted once its last stage is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        target = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(target)
        return self.spark.read.parquet(target)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        # the shuffle files of finished steps go when the driver collects the plans that named them
        self.spark._jvm.java.lang.System.gc()


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of ``links`` (a, b): the smallest id reachable.

    Each round takes the smallest label among the neighbours and then the label of that label, so long chains halve;
    every round is a written table, hence a lost executor repeats one round at most.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("_near"))
        lower = labels.join(near, "id").select("id", F.least("component", "_near").alias("_low"), F.col("component").alias("_old"))
        jump = labels.select(F.col("id").alias("_low"), F.col("component").alias("_jump"))
        after = lower.join(jump, "_low", "left").select("id", F.least("_low", "_jump").alias("component"), "_old")
        after = stage(after, "labels")
        changed = after.where("component != _old").limit(1).count()
        labels = after.select("id", "component")
        if not changed:
            return labels
