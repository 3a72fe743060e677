"""Mixing sources to target weights.

Words are summed per source, targets follow from the source weights under a repetition limit, and
each document is taken floor(rate) times plus once more with probability rate - floor(rate), decided
by a seeded hash of its id.  DataFrame functions only.

Defined cases: a null text has size 0; null sources form one source, last in order; an empty table
gives no rows; rows that repeat a doc_id draw the same number of copies; other columns are ignored
by :func:`mix` and kept by :func:`emit`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep.llm.common import BLANK_WORD, broadcast_if_small, null_safe, stored
from textprep.operators.ranking import global_rank

SEED = "mix-1"
MAX_REPEAT = 3
WEIGHTS = 3  # the sources weigh 1, 2, 3, 1, 2, 3, ... in code-point order


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(BLANK_WORD)), F.lit(0)).cast("long")


def uniform(seed: str, key: Column) -> Column:
    """[0, 1) from the first 52 bits of an MD5 of seed and key."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT, weights: int = WEIGHTS) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, size)``.

    All words are shared out by weight; a source stops at ``max_repeat`` times its size, and the
    excess goes to the rest by weight until none is above: with level = (all words - limits of the
    stopped) / (weights of the others), the stopped sources are those whose limit lies below level x
    weight.  Every round is one small aggregation of the source table; only its sums reach the driver."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(per, [F.col("source").asc_nulls_last()], "_rank")
    per = stored(
        ranked.select(
            "source",
            "source_size",
            ((F.col("_rank") - 1) % weights + 1).cast("double").alias("weight"),
            (F.col("source_size") * max_repeat).cast("double").alias("limit"),
        ),
        "sources",
    )
    total, weight = per.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return per.select("source", "source_size", F.lit(0.0).alias("target"))
    level, stopped = total / weight, 0
    while True:
        n, held, gone = per.where(F.col("limit") < F.lit(level) * F.col("weight")).agg(
            F.count("*"), F.coalesce(F.sum("limit"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))
        ).first()
        if n == stopped:
            break
        level, stopped = (total - held) / (weight - gone), n
    return per.select("source", "source_size", F.least("limit", F.lit(level) * F.col("weight")).alias("target"))


def _decide(sized: DataFrame, seed: str, max_repeat: int, weights: int) -> DataFrame:
    """``sized(doc_id, source, size, ...)`` with source_size, target, copies and taken.  The source table is
    broadcast where its size is proven small; else the join shuffles, and AQE splits the partition of
    a hot source."""
    plan = stored(source_targets(sized.select("source", "size"), max_repeat, weights).withColumnRenamed("source", "_source"), "targets")
    plan = broadcast_if_small(plan, F.coalesce(F.octet_length("_source"), F.lit(0)) + 48)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(0.0)
    extra = uniform(seed, F.col("doc_id")) < rate - F.floor(rate)
    out = null_safe(sized, plan, {"source": "_source"}, "inner").drop(plan["_source"])
    out = out.withColumn("copies", F.floor(rate) + extra.cast("long"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, seed: str = SEED, max_repeat: int = MAX_REPEAT, weights: int = WEIGHTS) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` of each row of ``docs(doc_id, text, source)``."""
    return _decide(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), seed, max_repeat, weights)


def emit(docs: DataFrame, seed: str = SEED, max_repeat: int = MAX_REPEAT, weights: int = WEIGHTS) -> DataFrame:
    """The mix itself: every document of ``docs`` as many times as it is taken, all columns kept.  The
    row travels as one column, so none of its names can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = docs.select(row, "doc_id", "source", word_count(F.col("text")).alias("size"))
    taken = _decide(sized, seed, max_repeat, weights).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
