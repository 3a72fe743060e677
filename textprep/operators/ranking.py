"""Ranks and counters without single-partition windows (H3, H4).

* :func:`hash_rank` - rank inside groups in seeded-hash order.  A hot group (one class may hold
  a third of all rows) is cut into ``buckets`` hash ranges; each range is ranked by its own
  window task and shifted by the rows of the earlier ranges (a groups x buckets side table).
* :func:`global_rank` - rank in an arbitrary total order: range partitioning + sort within
  partitions + row position, then per-partition offsets (a side table of one row per partition).
  The positions are made stable by a reliable checkpoint before they are counted.
* :func:`global_offsets` - the same for running sums of a weight column.
* :func:`expand_counts` - one row per ``j = 1..n`` for each row of a small table, generated in
  parallel blocks instead of exploding a huge sequence inside one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textprep.functions.hashing import hex_bucket
from textprep.session import checkpointed, shuffle_partitions

POSITION_BITS = 33  # monotonically_increasing_id = partition id << 33 | row position


def _cols(xs) -> list:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def hash_rank(
    df: DataFrame,
    by: Sequence[str],
    hash_col: str,
    tiebreak: Sequence[str],
    rank_col: str = "rn",
    buckets: int | None = None,
    size_col: str | None = None,
    before_col: str | None = None,
) -> DataFrame:
    """1-based rank of each row inside its ``by`` group, ordered by ``(hash_col, *tiebreak)``.

    ``hash_col`` must hold a hex digest (uniform); the result equals
    ``row_number() OVER (PARTITION BY by ORDER BY hash_col, tiebreak)``.  Optionally adds the
    group size (``size_col``) and the number of rows in groups that sort before this one
    (``before_col``), both read off the same small side table.

    The group is carried as one struct column: struct equality treats null fields as equal, so a
    null label is a group of its own, and the side-table join and the window share one
    partitioning - the data is shuffled once.  The side table holds one row per non-empty
    (group, bucket): tiny for class labels; with very many small groups it approaches the row
    count, and the join then sort-merges on the same partitioning instead of broadcasting."""
    nb = buckets or max(8, shuffle_partitions(df.sparkSession))
    by = list(by)
    d = df.withColumn("_hb", hex_bucket(F.col(hash_col), nb)).withColumn("_gk", F.struct(*[F.col(c) for c in by]))
    counts = d.groupBy("_gk", "_hb").agg(F.count(F.lit(1)).alias("_hn"))
    side = counts.select(
        "_gk",
        "_hb",
        (F.sum("_hn").over(Window.partitionBy("_gk").orderBy("_hb")) - F.col("_hn")).alias("_hoff"),
        F.sum("_hn").over(Window.partitionBy("_gk")).alias("_gsize"),
    )
    if before_col:
        totals = counts.groupBy("_gk").agg(F.sum("_hn").alias("_gt"))
        totals = totals.select("_gk", (F.sum("_gt").over(Window.orderBy("_gk")) - F.col("_gt")).alias(before_col))
        side = side.join(totals, "_gk")
    # The side table has groups x buckets rows.  It is joined on the window's own partition key,
    # so the data is shuffled once whether AQE broadcasts the side (when it is small at run
    # time) or sort-merge joins it.
    w = Window.partitionBy("_gk", "_hb").orderBy(F.col(hash_col), *_cols(tiebreak))
    out = d.join(side, ["_gk", "_hb"]).withColumn(rank_col, (F.col("_hoff") + F.row_number().over(w)).cast("long"))
    if size_col:
        out = out.withColumnRenamed("_gsize", size_col)
    else:
        out = out.drop("_gsize")
    return out.drop("_hb", "_hoff", "_gk")


def global_rank(
    df: DataFrame, order: Sequence, rank_col: str = "rn", partitions: int | None = None
) -> DataFrame:
    """1-based rank in the total order ``order`` (its last column must make it unique).

    The input is materialised first: range partitioning samples it in a job of its own, and
    without the copy that job and the ranking job would both recompute the upstream plan."""
    order = _cols(order)
    # Without an explicit count AQE may merge adjacent ranges of a small input; merged ranges
    # stay in order, so partition index + row position still give the global order.
    base = checkpointed(df)
    d = (base.repartitionByRange(partitions, *order) if partitions else base.repartitionByRange(*order)).sortWithinPartitions(*order)
    d = checkpointed(d.withColumn("_mid", F.monotonically_increasing_id()))
    d = d.withColumn("_pid", F.shiftright("_mid", POSITION_BITS))
    counts = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_pn"))
    # one row per partition: bounded by n, broadcast without a check
    offsets = F.broadcast(counts.select("_pid", (F.sum("_pn").over(Window.orderBy("_pid")) - F.col("_pn")).alias("_poff")))
    mask = (1 << POSITION_BITS) - 1
    return (
        d.join(offsets, "_pid")
        .withColumn(rank_col, F.col("_poff") + F.col("_mid").bitwiseAND(F.lit(mask)) + 1)
        .drop("_pid", "_mid", "_poff")
    )


def global_offsets(
    df: DataFrame, order: Sequence, weight_col: str, out_col: str = "offset", partitions: int | None = None
) -> DataFrame:
    """``out_col`` = sum of ``weight_col`` over all rows strictly before this one in ``order``."""
    order = _cols(order)
    d = (df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    schema = T.StructType(d.schema.fields + [T.StructField("_pid", T.IntegerType()), T.StructField("_loc", T.LongType())])

    def running(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        total = 0
        for pdf in batches:
            w = pdf[weight_col].fillna(0).astype("int64")
            cs = w.cumsum()
            loc = cs - w + total
            total += int(w.sum())
            yield pdf.assign(_pid=pid, _loc=loc)

    d = checkpointed(d.mapInPandas(running, schema))
    totals = d.groupBy("_pid").agg(F.sum(F.coalesce(F.col(weight_col), F.lit(0))).alias("_pt"))
    offsets = F.broadcast(totals.select("_pid", (F.sum("_pt").over(Window.orderBy("_pid")) - F.col("_pt")).alias("_poff")))
    return d.join(offsets, "_pid").withColumn(out_col, (F.col("_poff") + F.col("_loc")).cast("long")).drop("_pid", "_loc", "_poff")


def expand_counts(small: DataFrame, count_col: str, out_col: str = "j", block: int = 100_000) -> DataFrame:
    """For each row of ``small`` emit rows ``j = 1..count`` (count may be huge).

    Blocks of ``block`` draws are listed first (a table of sum(count)/block rows), spread over
    the cluster, and only then exploded, so no task generates more than ``block`` rows per
    input row."""
    spark = small.sparkSession
    n = shuffle_partitions(spark)
    cnt = F.col(count_col)
    blocks = small.withColumn(
        "_blk", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(cnt / block) - 1, F.lit(0))))
    ).filter(cnt > 0)
    blocks = blocks.repartition(n, "_blk", *[c for c in small.columns if c != count_col])
    start = F.col("_blk") * block + 1
    stop = F.least(cnt, (F.col("_blk") + 1) * block)
    return blocks.withColumn(out_col, F.explode(F.sequence(start.cast("long"), stop.cast("long")))).drop("_blk")


def order_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
