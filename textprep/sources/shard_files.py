"""B6, B7, S7 for readers: shards and their batches as files, with a manifest from which a reader resumes.

Rows lie in ``shard=<s>/part=<p>/``, a part being a run of whole batches, sorted by batch and place in one file.  The manifest has a row for each part:
its batches, how many rows it has and how many rows of its shard come before.  It is written last, so a layout without one is unfinished.  A reader that
stopped at (shard, batch) opens the parts that the manifest names from there on, and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "_manifest"


def write_shards(df: DataFrame, path: str, batches_per_part: int = 1000, shard_col: str = "shard", batch_col: str = "batch_id", place_col: str = "in_batch") -> None:
    """Lay out rows that have their shard, batch and place (:func:`textprep.operators.sampling.batches`).  One shuffle; a task
    writes whole parts."""
    if batches_per_part < 1:
        raise ValueError("a part holds one batch at least")
    names = {shard_col: "shard", batch_col: "batch_id", place_col: "in_batch"}
    clash = [c for c in df.columns if c in ("shard", "part", "batch_id", "in_batch") and c not in names]
    if clash:
        raise ValueError(f"columns would clash: {clash}")
    for old, new in names.items():
        df = df.withColumnRenamed(old, new)
    part = F.call_function("div", F.col("batch_id"), F.lit(batches_per_part)).cast("long")
    rows = df.withColumn("part", part).repartition("shard", "part").sortWithinPartitions("shard", "part", "batch_id", "in_batch")
    rows.write.partitionBy("shard", "part").parquet(path)
    spark = df.sparkSession
    whole = df.schema["shard"].dataType.simpleString()
    stored = spark.read.parquet(path).select(F.col("shard").cast(whole).alias("shard"), F.col("part").cast("long").alias("part"), F.col("batch_id").cast("long").alias("batch_id"))
    parts = stored.groupBy("shard", "part").agg(
        F.min("batch_id").alias("first_batch"), F.max("batch_id").alias("last_batch"), F.count(F.lit(1)).alias("rows"), F.countDistinct("batch_id").alias("batches")
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.withColumn("first_row", F.coalesce(F.sum("rows").over(before), F.lit(0))).write.parquet(f"{path.rstrip('/')}/{MANIFEST}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, part, first_batch, last_batch, rows, batches, first_row)``; an error where the layout was never finished."""
    return spark.read.parquet(f"{path.rstrip('/')}/{MANIFEST}")


def read_from(spark: SparkSession, path: str, shard: int, batch: int = 0) -> DataFrame:
    """Rows of a shard from a batch on, a part after the other; only their parts are listed and read."""
    parts = read_manifest(spark, path).where((F.col("shard") == shard) & (F.col("last_batch") >= batch)).orderBy("part").select("part").collect()
    base = path.rstrip("/")
    if not parts:
        return spark.read.parquet(base).where("false")
    # one row of the manifest for batches_per_part batches of one shard
    files = spark.read.option("basePath", base).parquet(*[f"{base}/shard={shard}/part={r['part']}" for r in parts])
    return files.where(F.col("batch_id") >= batch)


def position(spark: SparkSession, path: str, shard: int, row: int) -> tuple[int, int] | None:
    """``(part, rows of it to skip)`` of the ``row``-th row of a shard, from the manifest alone; None behind its end."""
    found = read_manifest(spark, path).where((F.col("shard") == shard) & (F.col("first_row") <= row) & (F.col("first_row") + F.col("rows") > row)).first()
    return found and (found["part"], row - found["first_row"])
