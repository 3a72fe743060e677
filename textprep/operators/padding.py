"""T13, T19, B7 by length: rows are padded to the longest of their bucket, not of the whole frame.

The lengths' histogram decides the borders: of all ways to cut the lengths into ``buckets`` runs the one with the fewest pads (dynamic
programming over the distinct lengths).  The histogram is one row per length; where there are more than ``LENGTHS`` of them, neighbours
share a border, which only adds pads.  Batches are drawn inside a bucket in a seeded order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textprep.functions.hashing import hash_hex
from textprep.operators.ranking import hash_rank
from textprep.operators.tokens import IGNORE_LABEL, PAD_ID, pad_right
from textprep.session import checkpointed

LENGTHS = 4096  # distinct borders that are weighed against each other


def least_pads(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Borders (ascending, the last is the longest length) that pad the least, and how many pads that takes."""
    if not len(lengths):
        return [], 0
    order = np.argsort(lengths)
    x, n = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    rows, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * x)])
    # pads of lengths a..b-1 in one bucket: x[b-1] * rows - tokens
    best = x * rows[1:] - tokens[1:]  # one bucket up to each length
    cuts = []
    for _ in range(min(buckets, len(x)) - 1):
        new, cut = best.copy(), np.zeros(len(x), np.int64)
        for b in range(1, len(x)):
            cost = best[:b] + x[b] * (rows[b + 1] - rows[1 : b + 1]) - (tokens[b + 1] - tokens[1 : b + 1])
            a = int(cost.argmin())
            if cost[a] < new[b]:
                new[b], cut[b] = cost[a], a + 1
        best = new
        cuts.append(cut)
    borders, at = [], len(x) - 1
    for cut in reversed(cuts):
        borders.append(int(x[at]))
        if not cut[at]:
            break
        at = int(cut[at]) - 1
    else:
        borders.append(int(x[at]))
    return borders[::-1], int(best[-1])


def length_borders(df: DataFrame, length_col: str, buckets: int = 8) -> list[int]:
    """Borders of the buckets; rows without a length count as length 0.  What reaches the driver is the histogram, ``LENGTHS`` rows at most."""
    if buckets < 1:
        raise ValueError("one bucket at least")
    histogram = checkpointed(df.groupBy(F.coalesce(F.col(length_col), F.lit(0)).alias("x")).agg(F.count(F.lit(1)).alias("n")))
    longest, distinct = histogram.agg(F.max("x"), F.count(F.lit(1))).first()
    if distinct > LENGTHS:  # the longest of each run of lengths stands for it
        step = -(-(longest + 1) // LENGTHS)
        histogram = histogram.groupBy(F.call_function("div", F.col("x"), F.lit(step)).alias("r")).agg(F.max("x").alias("x"), F.sum("n").alias("n"))
    rows = histogram.select("x", "n").collect()
    return least_pads(np.array([r["x"] for r in rows]), np.array([r["n"] for r in rows]), buckets)[0]


def with_border(df: DataFrame, length_col: str, borders: list[int], out_col: str = "padded_len") -> DataFrame:
    """The least border that a row's length fits."""
    if not borders:
        return df.withColumn(out_col, F.lit(None).cast("int"))
    x, found = F.coalesce(F.col(length_col), F.lit(0)), F.lit(borders[-1])
    for border in reversed(borders[:-1]):
        found = F.when(x <= border, F.lit(border)).otherwise(found)
    return df.withColumn(out_col, found.cast("int"))


def bucketed_batches(df: DataFrame, ids_col: str, batch_size: int, key_cols, buckets: int = 8, seed: int = 42, epoch: int = 0, label_col: str | None = None,
                     pad_value: int = PAD_ID, label_pad: int = IGNORE_LABEL, borders: list[int] | None = None) -> DataFrame:
    """Rows with ``padded_len``, ``batch_id`` (from 0 in each bucket), ``in_batch`` and ``attention_mask``, padded to their bucket.  ``borders`` of an earlier
    run save the histogram; a longer row than its border is an error of the caller and stays as it is."""
    d = checkpointed(df.withColumn("_len", F.coalesce(F.size(ids_col), F.lit(0))))  # read for the histogram, the places and the rows
    d = with_border(d, "_len", length_borders(d, "_len", buckets) if borders is None else borders).drop("_len")
    keys = list(key_cols)
    place = d.select(*keys, "padded_len").withColumn("_h", hash_hex(seed, F.lit("pad"), epoch, *keys))
    place = hash_rank(place, ["padded_len"], "_h", keys, rank_col="_place").select(*keys, F.col("_place") - 1)
    place = place.toDF(*keys, "_place")
    d = d.join(place, keys).withColumn("batch_id", F.call_function("div", F.col("_place"), F.lit(batch_size))).withColumn("in_batch", (F.col("_place") % batch_size).cast("int"))
    return pad_right(d.drop("_place"), ids_col, F.col("padded_len"), pad_value, "attention_mask", label_col, label_pad)
