"""Labels and class statistics.

All class statistics reduce the data to one row per class first (partial aggregation, so a
skewed class costs nothing extra); what follows runs on that tiny table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textprep.session import small_side


def to_binary(df: DataFrame, label_col: str = "label") -> DataFrame:
    """``label > 0 -> 1``."""
    return df.withColumn(label_col, F.when(F.col(label_col) > 0, F.lit(1)).otherwise(F.col(label_col)).cast("int"))


def drop_negative_shift(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Keep ``label > 0`` and shift down by one (the second-stage label space)."""
    return df.filter(F.col(label_col) > 0).withColumn(label_col, (F.col(label_col) - 1).cast("int"))


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """G6 core: rows per class; null labels do not count."""
    return df.filter(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label_col: str = "label", scheme: str = "total_over_count") -> DataFrame:
    """One row per class ``(label, n, w)``, ordered by label when listed.

    ``total_over_count``: ``w = N / n_c`` (the reference's default); ``inverse``: ``w = 1 / n_c``."""
    c = class_counts(df, label_col)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    if scheme == "total_over_count":
        w = total / F.col("n")
    elif scheme == "inverse":
        w = F.lit(1.0) / F.col("n")
    else:
        raise ValueError(f"unknown weight scheme {scheme!r}")
    return c.select(label_col, "n", w.cast("double").alias("w"))


def class_weight_list(df: DataFrame, label_col: str = "label", scheme: str = "total_over_count") -> list[float]:
    """G1 at the edge: the weights as a list positional by sorted label (what a weighted loss
    takes), one number per class."""
    return [float(r["w"]) for r in class_weights(df, label_col, scheme).orderBy(label_col).collect()]


def class_proportions(df: DataFrame, label_col: str = "label") -> DataFrame:
    """``(label, n, prop = n / N)``."""
    c = class_counts(df, label_col)
    return c.select(label_col, "n", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("prop"))


def sample_weights(df: DataFrame, label_col: str = "label", scheme: str = "total_over_count", out_col: str = "w") -> DataFrame:
    """Each row gets its class weight (left join; a null label gets a null weight).
    The class table has one row per class and is broadcast after a size check."""
    w = class_weights(df, label_col, scheme).select(F.col(label_col), F.col("w").alias(out_col))
    return df.join(small_side(w), label_col, "left")


def balance_report(df: DataFrame, group_col: str, label_col: str = "label") -> DataFrame:
    """Per group (e.g. shard): size, number of classes, mean and unbiased standard deviation
    of the class proportions."""
    c = df.groupBy(group_col, label_col).agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("prop", F.col("n") / F.sum("n").over(Window.partitionBy(group_col)))
    return c.groupBy(group_col).agg(
        F.sum("n").alias("size"),
        F.count(F.lit(1)).alias("n_classes"),
        F.avg("prop").alias("mean_prop"),
        F.stddev_samp("prop").alias("std_prop"),
    )


def class_size_range(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Smallest and largest class size, number of classes."""
    c = class_counts(df, label_col)
    return c.agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.count(F.lit(1)).alias("n_classes"))


def label_domain_report(
    df: DataFrame, num_classes: int, split_col: str, label_col: str = "label", n_weights: int | None = None, raise_on_violation: bool = False
) -> DataFrame:
    """Per split, the distinct labels must be exactly ``0..C-1`` (and the weight list
    must have C entries).  One row per split with the facts and an ``ok`` flag; on request a violation raises.
    The distinct labels of a wrong column may be many: they are counted, not collected
    (:func:`label_violations` lists the wrong ones as a table)."""
    labels = df.select(split_col, label_col).distinct()
    wrong = F.col(label_col).isNull() | (F.col(label_col) < 0) | (F.col(label_col) >= num_classes)
    r = labels.groupBy(split_col).agg(
        F.min(label_col).alias("min_label"),
        F.max(label_col).alias("max_label"),
        F.count(label_col).alias("n_distinct"),
        F.sum(wrong.cast("long")).alias("n_wrong"),
    )
    ok = (F.col("n_wrong") == 0) & (F.col("n_distinct") == num_classes)
    if n_weights is not None:
        ok = ok & F.lit(n_weights == num_classes)
    r = r.withColumn("ok", ok)
    if raise_on_violation:
        bad = [x[split_col] for x in r.filter(~F.col("ok")).select(split_col).limit(10).collect()]
        if bad:
            raise ValueError(f"labels are not 0..{num_classes - 1}, or weights don't match, in {bad}")
    return r


def label_violations(df: DataFrame, num_classes: int, split_col: str, label_col: str = "label") -> DataFrame:
    """``(split, label, n)``: labels outside ``0..C-1``, with their rows."""
    wrong = F.col(label_col).isNull() | (F.col(label_col) < 0) | (F.col(label_col) >= num_classes)
    return df.filter(wrong).groupBy(split_col, label_col).agg(F.count(F.lit(1)).alias("n"))
