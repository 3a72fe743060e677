"""J5 and B1-B4 for many epochs: rows are ranked once, epochs only draw ranks.

The store holds ``(label, rn, n, key)``: the rank of every row in its class in a seeded order, bucketed by ``(label, rn)``.  An epoch takes
without replacement by a permutation of the ranks that is computed draw by draw (swap-or-not: a round's key pairs every rank with a
partner, and a hash of the larger one decides whether they change places), with replacement by uniform ranks.  The draws meet
the store by an equi-join on its bucket columns, so no epoch ranks, sorts by hash, or shuffles the rows again.  A rank is a uniform key, whatever the
class sizes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textprep.functions.hashing import hash_hex, uniform
from textprep.operators.ranking import expand_counts, hash_rank
from textprep.session import checkpointed, shared_dir, shuffle_partitions

ROUNDS = 6  # of the permutation


def write_ranked(df: DataFrame, label_col: str = "label", key_col: str = "index", seed: int = 42, name: str | None = None, path: str | None = None,
                 buckets: int | None = None) -> str:
    """Rank the rows once and store them; returns the table's name.  Rows without a label belong to no class."""
    spark = df.sparkSession
    name = name or f"ranked_{uuid.uuid4().hex}"
    n = buckets or max(8, shuffle_partitions(spark))
    d = df.select(label_col, key_col).filter(F.col(label_col).isNotNull()).withColumn("_sh", hash_hex(seed, F.lit("row"), key_col))
    ranked = hash_rank(d, [label_col], "_sh", [key_col], rank_col="rn", size_col="n").select(label_col, "rn", F.col("n").cast("long").alias("n"), key_col)
    # dealt as the buckets are: each task writes one file
    files = ranked.repartition(n, label_col, "rn").write.bucketBy(n, label_col, "rn").sortBy(label_col, "rn")
    files.option("path", path or f"{shared_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    return name


def open_ranked(spark: SparkSession, name: str, path: str, schema: str, buckets: int, label_col: str = "label") -> DataFrame:
    """The store of an earlier application whose catalog is gone; ``schema`` as DDL, ``buckets`` as it was written."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({schema}) USING parquet CLUSTERED BY (`{label_col}`, rn) SORTED BY (`{label_col}`, rn) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def store_sizes(store: DataFrame, label_col: str = "label") -> DataFrame:
    """``(label, n)`` of the stored classes: their first ranks tell."""
    return store.filter(F.col("rn") == 1).select(label_col, "n")


def _permuted(label_col: str, seed: int):
    """A rank from 0 for each ``j``: a permutation of the class's ranks for each epoch.  One fold over the rounds' keys, as
    chained columns would be inlined into one another."""

    def step(x, k):
        partner = F.pmod(k["key"] - x, F.col("n"))
        swap = F.substring(hash_hex(seed, F.lit("swap"), "epoch", label_col, k["r"], F.greatest(x, partner)), 1, 1) < "8"
        return F.when(swap, partner).otherwise(x)

    return F.aggregate("_keys", F.col("j") - 1, step)


def draw_epochs(store: DataFrame, targets: DataFrame, label_col: str = "label", key_col: str = "index", seed: int = 42) -> DataFrame:
    """``(epoch, label, j, key)`` for ``targets (epoch, label, target)``: ``target`` draws of a class in each epoch, without replacement
    if it has that many rows."""
    keys = [F.floor(uniform(seed, F.lit("key"), "epoch", label_col, F.lit(r)) * F.col("n")).cast("long") for r in range(1, ROUNDS + 1)]
    keys = F.array(*[F.struct(F.lit(r).alias("r"), key.alias("key")) for r, key in enumerate(keys, 1)])
    t = targets.select("epoch", label_col, F.col("target").cast("long").alias("target"))
    t = checkpointed(t.join(store_sizes(store, label_col), label_col).withColumn("_keys", keys))
    picks = expand_counts(t, "target", "j")
    again = F.floor(uniform(seed, F.lit("draw"), "epoch", label_col, "j") * F.col("n")).cast("long")
    rank = F.when(F.col("target") <= F.col("n"), _permuted(label_col, seed)).otherwise(again) + 1
    picks = picks.select("epoch", label_col, "j", F.coalesce(rank, F.lit(0)).alias("rn"))
    # as in sampling.draw: the draws look as small as the rows that they are made of
    return picks.hint("merge").join(store.select(label_col, "rn", key_col), [label_col, "rn"]).select("epoch", label_col, "j", key_col)


def epoch_targets(store: DataFrame, epochs: Sequence[int], mode="downsampling", label_col: str = "label") -> DataFrame:
    """B1-B3 for several epochs: ``(epoch, label, target)`` as :func:`textprep.operators.sampling.class_targets` has them."""
    from pyspark.sql import Window

    every = Window.partitionBy(F.lit(0))  # one row per class
    target = {"downsampling": F.min("n").over(every), "upsampling": F.max("n").over(every)}.get(mode, F.lit(mode))
    t = store_sizes(store, label_col).withColumn("target", target.cast("long"))
    return t.select(F.explode(F.array(*map(F.lit, epochs))).alias("epoch"), label_col, "target")
