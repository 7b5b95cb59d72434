"""Joins and numbering that survive a key holding a large share of all rows, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

SALTS = 64


def heavy_keys(df: DataFrame, keys: list[str], total: int | None = None) -> DataFrame:
    """Keys that fill a good part of a shuffle partition: at least a quarter of an even one.

    There are never more than four times as many as shuffle partitions, which bounds the broadcast of the list.  With the
    number of rows given (``total``), the keys are counted once.
    """
    share = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.select(*keys).dropna().groupBy(*keys).agg(F.count("*").alias("_n"))
    floor = counts.agg(F.sum("_n")).scalar() if total is None else F.lit(total)
    return counts.where(F.col("_n") * share >= floor).where("_n > 1").select(*keys)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    spread: Column,
    how: str = "left",
    counted: DataFrame | None = None,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Join where ``big`` may be skewed on ``keys``.

    Rows of heavy keys are spread over ``SALTS`` sub-keys by a hash of ``spread``; only the matching rows of
    ``small`` are repeated, so light keys cost nothing extra.  The heavy-key list is bounded (see
    ``heavy_keys``), hence the broadcasts.  Pass the stored table behind ``big`` as ``counted`` when ``big`` is
    costly, so that counting reads the key columns only, or a stored ``heavy`` list when one table is joined many
    times; which keys are salted never changes the result.
    """
    if heavy is None:
        heavy = heavy_keys(big if counted is None else counted, keys)
    heavy = heavy.withColumn("_heavy", F.lit(True))
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    left = big.join(F.broadcast(heavy), keys, "left").withColumn("_salt", salt).drop("_heavy")
    salts = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = small.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.explode(salts)).drop("_heavy")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


FAN = 1024  # blocks under one head in a prefix scan
_SCANS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which a null key equals a null key; ``right`` has each key once."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    return left.join(renamed, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], "left").drop(*[f"_r_{k}" for k in keys])


def _before_blocks(blocks: DataFrame, key: str, how: str, levels: int) -> DataFrame:
    """Adds ``_before``: ``_value`` combined over the earlier blocks of the key.  ``blocks``: key, _block, _value.

    A window sees the blocks under one head only; what lies before the head comes from the scan over heads.
    """
    combine, both = _SCANS[how]
    if levels == 0:
        earlier = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
        return blocks.withColumn("_before", combine("_value").over(earlier))
    under = blocks.withColumn("_head", F.floor(F.col("_block") / FAN))
    heads = under.groupBy(key, F.col("_head").alias("_block")).agg(combine("_value").alias("_value"))
    heads = _before_blocks(heads, key, how, levels - 1).select(key, F.col("_block").alias("_head"), F.col("_before").alias("_ahead"))
    earlier = W.partitionBy(key, "_head").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    scanned = _same(under.withColumn("_in", combine("_value").over(earlier)), heads, [key, "_head"])
    return scanned.select(key, "_block", "_value", both(F.col("_in"), F.col("_ahead")).alias("_before"))


def running_before(df: DataFrame, key: str, order: list[str], block: Column, value: Column, how: str, name: str) -> DataFrame:
    """``value`` combined (sum, max or min) over all rows of the key before each row, for keys of any size.

    ``block`` is a whole number that must not decrease along ``order`` and should change every few thousand rows.  Rows are
    scanned inside (key, block), blocks inside heads of ``FAN`` blocks, and so on: no task ever holds a whole key.  Before
    the first row stands null, or 0 for a sum.  Null keys are a key of their own.
    """
    combine, both = _SCANS[how]
    cut = df.withColumn("_block", block.cast("long")).withColumn("_value", value)
    blocks = cut.groupBy(key, "_block").agg(combine("_value").alias("_value"))
    offsets = _before_blocks(blocks, key, how, 2).select(key, "_block", "_before")
    earlier = W.partitionBy(key, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    scanned = _same(cut.withColumn("_local", combine("_value").over(earlier)), offsets, [key, "_block"])
    return scanned.withColumn(name, both(F.col("_local"), F.col("_before"))).drop("_block", "_value", "_local", "_before")


def number_within(df: DataFrame, key: str, order: list[str], block: Column, name: str = "rn") -> DataFrame:
    """Exact 1-based ``row_number`` over ``key`` ordered by ``order``, for keys of any size (see ``running_before``)."""
    return running_before(df, key, order, block, F.lit(1), "sum", name).withColumn(name, F.col(name) + 1)


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables: the one the cluster names, a scratch one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(scratch)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a lost executor never restarts an iterative job from its first round."""
    folder = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result that several later steps read, and read it back as a columnar table."""
    target = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.parquet(target)


class BucketedTables:
    """Tables of one job, bucketed by their join keys in the shared folder, so that joins leave their rows where they are.

    All have as many buckets as there are shuffle partitions, or ``buckets``, and a bucket is one file: opening files must
    not cost more than reading them.  ``drop`` removes tables and files.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self.count = spark, f"{name}_{uuid.uuid4().hex}", 0
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = f"{shared_folder(spark)}/{self.name}"

    def put(self, df: DataFrame, keys: list[str]) -> DataFrame:
        table = f"{self.name}_{self.count}"
        self.count += 1
        writer = df.repartition(self.buckets, *keys).write.format("parquet").bucketBy(self.buckets, *keys)
        writer.option("path", f"{self.folder}/{table}").saveAsTable(table)
        return self.spark.table(table)

    def drop(self) -> None:
        for i in range(self.count):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{i}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
