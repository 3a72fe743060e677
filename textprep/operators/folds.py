"""Folds and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textprep.functions.hashing import hash_hex
from textprep.operators.ranking import hash_rank


def stratified_folds(
    df: DataFrame, label_col: str = "label", key_col: str = "index", k: int = 5, seed: int = 42, out_col: str = "cv",
    check: bool = True,
) -> DataFrame:
    """stratified k-fold id.  Only keys and labels are ranked; other columns are joined by key (unique and not
    null) at the end.  ``check``: raise if every class has fewer than ``k`` rows.

    Classes are laid end to end in label order; inside a class rows follow the seeded hash order;
    folds are dealt round robin: ``cv = (rows in earlier classes + rank - 1) % k``.  Per-class and
    overall fold sizes therefore differ by at most one.  Hot classes are ranked in hash ranges
    (``hash_rank``), so no class is ranked by a single task."""
    if check:
        most = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if most is not None and most < k:
            raise ValueError(f"every class has fewer than {k} rows")
    narrow = df.select(key_col, label_col).withColumn("_fh", hash_hex(seed, key_col))
    narrow = hash_rank(narrow, [label_col], "_fh", [key_col], rank_col="_frn", before_col="_fbefore")
    cv = ((F.col("_fbefore") + F.col("_frn") - 1) % k).cast("int").alias(out_col)
    if set(df.columns) <= {key_col, label_col}:
        return narrow.select(*df.columns, cv)
    folds = narrow.select(F.col(key_col).alias("_fkey"), cv)
    return df.join(folds, F.col(key_col) == F.col("_fkey")).drop("_fkey")


def shuffled_folds(df: DataFrame, key_col: str = "index", k: int = 5, seed: int = 42, out_col: str = "cv") -> DataFrame:
    """shuffle, cut into k blocks of ``n // k`` rows, the remainder goes to the last fold."""
    d = df.withColumn("_fh", hash_hex(seed, key_col))
    d = hash_rank(d, [], "_fh", [key_col], rank_col="_frn", size_col="_fn")
    sz = F.call_function("div", F.col("_fn"), F.lit(k))
    cv = F.when(sz == 0, F.lit(k - 1)).otherwise(F.least(F.call_function("div", F.col("_frn") - 1, sz), F.lit(k - 1)))
    return d.withColumn(out_col, cv.cast("int")).drop("_fh", "_frn", "_fn")


def cv_split(df: DataFrame, cv: int, cv_col: str = "cv") -> tuple[DataFrame, DataFrame]:
    """(train, valid) = (cv != fold, cv == fold); rows with a null fold are in neither."""
    return df.filter(F.col(cv_col) != cv), df.filter(F.col(cv_col) == cv)


def tail_holdout(df: DataFrame, key_col: str = "index", n: int = 200, out_col: str = "split") -> DataFrame:
    """the last ``n`` rows by key validate, the others train.

    The ``n``-th largest key is found by a distributed top-n (each task keeps at most n keys),
    so the split itself is a plain projection with no shuffle of the data."""
    if n <= 0:
        return df.withColumn(out_col, F.lit("train"))
    kth = df.select(key_col).orderBy(F.col(key_col).desc()).limit(n).agg(F.min(key_col).alias("k")).first()["k"]
    if kth is None:
        return df.withColumn(out_col, F.lit("train"))
    return df.withColumn(out_col, F.when(F.col(key_col) >= F.lit(kth), "valid").otherwise("train"))
