"""Sampling, sharding and batching.

A sample is a table ``(label, j, key)``: draw ``j`` of class ``label`` picked row ``key``.
Draws are exact in size (not Bernoulli like ``sample``/``sampleBy``):

* without replacement (a class has at least as many rows as draws): draw ``j`` takes the row of
  rank ``j`` in seeded hash order (rank from :func:`hash_rank`, hot classes split by ranges);
* with replacement (more draws than rows): draw ``j`` takes rank ``floor(u(seed, label, j) * n_c) + 1``.

Classes drawn without replacement are a filter on the rank.  Only the others get a draw list,
generated in parallel blocks (:func:`expand_counts`) and equi-joined to their ranked rows on
``(label, rank)`` - a uniform key.

Every hash includes the seed and the epoch, so each epoch redraws and any run reproduces.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textprep.functions.hashing import hash_hex, hex_bucket, uniform
from textprep.operators.labels import class_counts
from textprep.operators.ranking import expand_counts, global_rank, hash_rank
from textprep.session import BROADCAST_BYTES, checkpointed, shuffle_partitions, small_side, table_bytes


BUCKET_ROWS = 2_000_000  # rows and draws of a bucket of a weighted draw, about
SMALL_CLASS = 100  # rows below which a dynamic schedule warns
RANGES = 4096  # equal cuts of [0, 1) in which a weighted draw looks for its class


def _ranked(df: DataFrame, label_col: str, key_col: str, seed: int, epoch: int) -> DataFrame:
    d = df.withColumn("_sh", hash_hex(seed, F.lit("row"), epoch, key_col))
    return hash_rank(d, [label_col], "_sh", [key_col], rank_col="_rn", size_col="_n").drop("_sh")


def class_targets(df: DataFrame, label_col: str = "label", mode="downsampling") -> DataFrame:
    """Per class ``(label, n, target)``: ``downsampling`` -> smallest class size for every
    class; ``upsampling`` -> largest; an int -> that many."""
    c = class_counts(df, label_col)
    every = Window.partitionBy(F.lit(0))
    if mode == "downsampling":
        t = F.min("n").over(every)
    elif mode == "upsampling":
        t = F.max("n").over(every)
    elif isinstance(mode, int):
        t = F.lit(mode)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return c.select(label_col, "n", t.cast("long").alias("target"))


def dynamic_targets(
    df: DataFrame,
    epochs: int,
    label_col: str = "label",
    exp_lambda: float = 0.9,
    start_epoch: int = 0,
    max_d: float | None = None,
    mode="downsampling",
    ignore_warning: bool = False,
) -> DataFrame:
    """B4 schedule: per ``(epoch, label)``: ``D_c = n_c / n_min``;
    ``target = int(min(D_c ** (lambda ** epoch), max_d) * base)``, ``base = n_min`` or the given
    int.  Pass ``e`` of the sampler uses epoch ``start_epoch + e``."""
    if not 0 < exp_lambda < 1:
        raise ValueError("exp_lambda must be in (0, 1)")
    if mode != "downsampling" and (isinstance(mode, bool) or not isinstance(mode, int)):
        raise ValueError(f"mode must be 'downsampling' or an int, not {mode!r}")
    c = class_counts(df, label_col)
    if not ignore_warning:
        least = c.agg(F.min("n")).first()[0]
        if least is not None and least < SMALL_CLASS:
            warnings.warn(f"the smallest class has {least} rows; draws repeat few rows", stacklevel=2)
    n_min = F.min("n").over(Window.partitionBy(F.lit(0)))
    base = n_min if mode == "downsampling" else F.lit(int(mode))
    c = c.select(label_col, "n", (F.col("n") / n_min).alias("_d"), base.cast("double").alias("_base"))
    e = F.explode(F.sequence(F.lit(start_epoch), F.lit(start_epoch + epochs - 1))).alias("epoch")
    c = c.select("*", e)
    cur = F.pow(F.col("_d"), F.pow(F.lit(exp_lambda), F.col("epoch").cast("double")))
    if max_d is not None:
        cur = F.least(cur, F.lit(float(max_d)))
    return c.select(
        F.col("epoch").cast("int"), label_col, "n", F.floor(cur * F.col("_base")).cast("long").alias("target")
    )


def draw(
    df: DataFrame,
    targets: DataFrame,
    label_col: str = "label",
    key_col: str = "index",
    seed: int = 42,
    epoch: int = 0,
) -> DataFrame:
    """Exact per-class draw: ``targets`` is a small ``(label, target[, n])`` table (one row per
    class; ``n`` = class size, counted here when absent).  Returns ``(label, j, key)`` with
    ``j = 1..target`` per class."""
    if "n" not in targets.columns:
        targets = targets.join(class_counts(df, label_col), label_col)
    t = checkpointed(targets.select(label_col, F.col("n").cast("long").alias("n"), F.col("target").cast("long").alias("target")))
    side = F.broadcast(t) if table_bytes(t) <= BROADCAST_BYTES else t  # only here: the hint would reach the draws made of t
    ranked = _ranked(df.select(label_col, key_col), label_col, key_col, seed, epoch).join(side.drop("n"), label_col)
    taken = ranked.filter((F.col("target") <= F.col("_n")) & (F.col("_rn") <= F.col("target")))
    taken = taken.select(label_col, F.col("_rn").alias("j"), key_col)
    # classes with more draws than rows: one draw row per (class, j), a uniform rank for each
    repeated = t.filter(F.col("target") > F.col("n"))
    u = uniform(seed, F.lit("draw"), epoch, label_col, "j")
    picks = expand_counts(repeated, "target", "j").withColumn("_rn", (F.floor(u * F.col("n")) + 1).cast("long"))
    rows = ranked.filter(F.col("target") > F.col("_n")).select(label_col, "_rn", key_col)
    # draws are made of few rows, so they look small to Spark: without the hint it collects all of them for a broadcast
    return taken.unionByName(picks.hint("merge").join(rows, [label_col, "_rn"]).select(label_col, "j", key_col))


def balanced_sample(df, label_col="label", key_col="index", mode="downsampling", seed=42, epoch=0) -> DataFrame:
    """B1 (downsampling), B2 (upsampling), B3 (int): every class gets the same number of draws;
    a class is drawn with replacement only if it has fewer rows than draws."""
    return draw(df, class_targets(df, label_col, mode), label_col, key_col, seed, epoch)


def dynamic_sample(df, epoch: int, label_col="label", key_col="index", seed=42, **schedule) -> DataFrame:
    """Draw of one epoch of the dynamic schedule."""
    start = schedule.get("start_epoch", 0)
    t = dynamic_targets(df, epoch - start + 1, label_col, **schedule).filter(F.col("epoch") == epoch)
    return draw(df, t.select(label_col, "n", "target"), label_col, key_col, seed, epoch)


def weighted_sample(
    df: DataFrame,
    n: int,
    weights: DataFrame,
    label_col: str = "label",
    key_col: str = "index",
    seed: int = 42,
    epoch: int = 0,
) -> DataFrame:
    """B5 with class-constant weights: ``n`` draws with replacement, row ``i`` with probability
    proportional to ``w[label_i]``.  A draw picks the class by its mass ``w_c * n_c``, then a row
    uniformly inside the class.  Classes tile [0, 1) with intervals; both sides are cut into
    ``RANGES`` equal ranges, so a draw finds its interval by an equi-join on the range.  The draw
    ids come from ``spark.range`` (generated in parallel)."""
    c = class_counts(df, label_col).join(weights.select(label_col, "w"), label_col)
    c = c.select(label_col, "n", (F.col("w") * F.col("n")).cast("double").alias("_m"))
    # one row per class; running sums in label order
    upto = Window.orderBy(label_col).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    c = c.withColumn("_sum", F.sum("_m").over(upto)).withColumn("_total", F.sum("_m").over(every)).withColumn("_last", F.max(label_col).over(every))
    lo = F.coalesce(F.lag("_sum").over(Window.orderBy(label_col)), F.lit(0.0)) / F.col("_total")
    hi = F.when(F.col(label_col) == F.col("_last"), F.lit(2.0)).otherwise(F.col("_sum") / F.col("_total"))
    c = c.select(label_col, F.col("n").alias("_n"), lo.alias("_lo"), hi.alias("_hi"))
    ranges = F.sequence(F.floor(F.col("_lo") * RANGES).cast("int"), F.least(F.floor(F.col("_hi") * RANGES), F.lit(RANGES - 1)).cast("int"))
    intervals = small_side(c.filter(F.col("_lo") < 1).withColumn("_range", F.explode(ranges)))
    d = df.sparkSession.range(n).select(
        (F.col("id") + 1).alias("j"), uniform(seed, F.lit("class"), epoch, "id").alias("_u"), uniform(seed, F.lit("row"), epoch, "id").alias("_u2")
    )
    d = d.withColumn("_range", F.floor(F.col("_u") * RANGES).cast("int")).join(intervals, "_range")
    d = d.filter((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    d = d.withColumn("_rn", (F.floor(F.col("_u2") * F.col("_n")) + 1).cast("long"))
    r = _ranked(df.select(label_col, key_col), label_col, key_col, seed, epoch)
    return d.join(r.select(label_col, "_rn", key_col), [label_col, "_rn"]).select(label_col, "j", key_col)


def shard(
    sample: DataFrame, replicas: int, seed: int = 42, epoch: int = 0, id_cols=("label", "j"), shuffle: bool = True
) -> DataFrame:
    """One shared shuffled order of the sample, padded to a multiple of ``replicas`` by
    repeating its head, position ``p`` goes to shard ``p % replicas`` at place ``p // replicas``.
    Adds ``pos``, ``shard``, ``local_pos``; shards are disjoint and equally long."""
    ids = list(id_cols)
    sample = checkpointed(sample)  # the order and its sizes both read the draw: it is drawn once
    if shuffle:
        s = sample.withColumn("_ph", hash_hex(seed, F.lit("perm"), epoch, *ids))
        s = hash_rank(s, [], "_ph", ids, rank_col="_pr", size_col="_L").drop("_ph")
    else:
        s = global_rank(sample, ids, rank_col="_pr")
        s = s.withColumn("_L", F.lit(s.count()))  # one scalar (the ranked rows are checkpointed)
    pos = F.col("_pr") - 1
    total = F.call_function("div", F.col("_L") + (replicas - 1), F.lit(replicas)) * replicas
    pad = total - F.col("_L")
    # position p >= L repeats position (p - L) % L
    copies = F.when(pos < pad, F.sequence(F.lit(0).cast("long"), F.call_function("div", pad - pos + F.col("_L") - 1, F.col("_L")) - 1)).otherwise(F.array().cast("array<long>"))
    s = s.select("*", F.explode(F.concat(F.array(F.lit(-1).cast("long")), copies)).alias("_copy"))
    p = F.when(F.col("_copy") < 0, pos).otherwise(F.col("_L") + pos + F.col("_copy") * F.col("_L"))
    s = s.withColumn("pos", p.cast("long"))
    return s.withColumn("shard", (F.col("pos") % replicas).cast("int")).withColumn(
        "local_pos", F.call_function("div", F.col("pos"), F.lit(replicas))
    ).drop("_pr", "_L", "_copy")


def batches(
    df: DataFrame, batch_size: int, drop_last: bool = False, group_col: str | None = "shard", pos_col: str = "local_pos",
    seed: int = 42, epoch: int = 0, shuffle: bool = False, id_cols=("label", "j"),
) -> DataFrame:
    """``batch_id = place // batch_size`` inside each group (shard); with ``shuffle`` the
    place is a fresh seeded order; ``drop_last`` drops the final incomplete batch."""
    by = [group_col] if group_col else []
    if shuffle:
        d = df.withColumn("_bh", hash_hex(seed, F.lit("batch"), epoch, *id_cols))
        d = hash_rank(d, by, "_bh", list(id_cols), rank_col="_place", size_col="_gn").drop("_bh")
        place = F.col("_place") - 1
    else:
        if by:
            sizes = small_side(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_gn")))
            d = df.join(sizes, by)
        else:
            d = df.withColumn("_gn", F.lit(df.count()))  # one scalar
        place = F.col(pos_col)
    d = d.withColumn("batch_id", F.call_function("div", place, F.lit(batch_size))).withColumn("in_batch", (place % batch_size).cast("int"))
    if drop_last:
        d = d.filter(F.col("batch_id") < F.call_function("div", F.col("_gn"), F.lit(batch_size)))
    return d.drop("_gn", *(["_place"] if shuffle else []))


def weighted_rows_sample(
    df: DataFrame,
    n: int,
    weight_col: str,
    key_col: str = "index",
    seed: int = 42,
    epoch: int = 0,
    buckets: int | None = None,
) -> DataFrame:
    """B5 with general per-row weights: ``n`` draws with replacement, row ``i`` with probability
    ``w_i / sum(w)``.  Returns ``(j, key)``.

    Rows in seeded hash order tile ``[0, sum(w))`` with intervals ``[lo_i, lo_i + w_i)``; draw
    ``j`` lands at ``x = u(seed, j) * sum(w)`` and takes the row whose interval holds ``x``.
    The hash order is cut into order-preserving hash buckets (about equal row counts); ``lo`` is a
    per-bucket running sum plus the bucket's offset (a side table of one row per bucket).  Buckets and heavy
    rows are intervals of the weight axis, and the axis is cut into equal ranges: both are side tables by
    range, so a draw finds its heavy row or its bucket by an equi-join on its range, then its row by a merge inside the bucket (a
    window over rows and draws ordered by position).  Heavy are rows of at least ``sum(w) / buckets``
    weight (at most ``buckets`` of them), so a row holding a third of the mass never sends a third of the draws into one task.
    Integer-valued weights give exact sums; only the total reaches the driver."""
    spark = df.sparkSession
    w = F.col(weight_col).cast("double")
    d = df.select(key_col, w.alias("_w")).filter(F.col("_w") > 0)
    # a bucket's rows and draws are merged by one task
    nb = buckets or max(8, shuffle_partitions(spark), (d.count() + n) // BUCKET_ROWS)
    d = d.withColumn("_h", hash_hex(seed, F.lit("wrow"), key_col)).withColumn("_hb", hex_bucket(F.col("_h"), nb))
    mass = d.groupBy("_hb").agg(F.sum("_w").alias("_m"))
    before = Window.orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)  # nb rows
    mass = checkpointed(mass.withColumn("_off", F.coalesce(F.sum("_m").over(before), F.lit(0.0))))
    total = mass.agg(F.max(F.col("_off") + F.col("_m"))).first()[0] or 0.0
    if total <= 0:
        raise ValueError("all weights are zero")
    run = Window.partitionBy("_hb").orderBy("_h", key_col).rowsBetween(Window.unboundedPreceding, -1)
    lo = F.col("_off") + F.coalesce(F.sum("_w").over(run), F.lit(0.0))
    rows = checkpointed(d.join(mass.select("_hb", "_off"), "_hb").withColumn("_lo", lo).drop("_off"))

    ranges = 4 * nb

    def range_of(c):
        return F.floor(c / F.lit(total) * ranges).cast("long")

    def by_range(intervals: DataFrame) -> DataFrame:
        """Intervals ``(_from, _to, ...)`` once for each range they reach into."""
        last = F.least(range_of(F.col("_to")), F.lit(ranges - 1).cast("long"))
        return small_side(intervals.withColumn("_in", F.explode(F.sequence(F.least(range_of(F.col("_from")), last), last))))

    heavy = rows.filter(F.col("_w") >= total / nb)
    heavy = by_range(heavy.select(F.col("_lo").alias("_from"), (F.col("_lo") + F.col("_w")).alias("_to"), F.col(key_col).alias("_heavy")))
    spans = by_range(mass.select(F.col("_off").alias("_from"), (F.col("_off") + F.col("_m")).alias("_to"), F.col("_hb").alias("_bucket")))
    draws = spark.range(n).select((F.col("id") + 1).alias("j"), (uniform(seed, F.lit("wdraw"), epoch, "id") * F.lit(total)).alias("_x"))
    draws = draws.withColumn("_range", F.least(range_of(F.col("_x")), F.lit(ranges - 1).cast("long")))
    inside = (F.col("_range") == F.col("_in")) & (F.col("_x") >= F.col("_from")) & (F.col("_x") < F.col("_to"))
    found = draws.join(heavy, inside, "left").drop("_in", "_from", "_to")
    direct = found.filter(F.col("_heavy").isNotNull()).select("j", F.col("_heavy").alias(key_col))
    rest = found.filter(F.col("_heavy").isNull()).drop("_heavy").join(spans, inside).withColumnRenamed("_bucket", "_hb")
    merged = rows.select("_hb", F.col("_lo").alias("_pos"), F.lit(0).alias("_kind"), key_col, F.lit(None).cast("long").alias("j")).unionByName(
        rest.select("_hb", F.col("_x").alias("_pos"), F.lit(1).alias("_kind"), F.lit(None).cast(rows.schema[key_col].dataType).alias(key_col), "j")
    )
    upto = Window.partitionBy("_hb").orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.withColumn("_pick", F.last(key_col, ignorenulls=True).over(upto))
    found = merged.filter(F.col("_kind") == 1).select("j", F.col("_pick").alias(key_col))
    return direct.unionByName(found)
