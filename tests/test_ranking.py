"""The distributed ranks equal a plain global row_number, for any partitioning."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textprep.functions.hashing import hash_hex
from textprep.operators.ranking import expand_counts, global_offsets, global_rank, hash_rank


def _data(spark, n=3000):
    # one hot class holding most rows (skew), two small ones
    return spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 3).alias("label"))


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_hash_rank_equals_row_number(spark, buckets):
    d = _data(spark).withColumn("h", hash_hex(7, "k"))
    got = hash_rank(d, ["label"], "h", ["k"], rank_col="rn", buckets=buckets, size_col="n", before_col="b")
    want = d.withColumn("rn2", F.row_number().over(Window.partitionBy("label").orderBy("h", "k")))
    j = got.join(want.select("k", "rn2"), "k")
    assert j.filter(F.col("rn") != F.col("rn2")).count() == 0
    sizes = {r["label"]: r["c"] for r in d.groupBy("label").agg(F.count("*").alias("c")).collect()}
    for r in got.select("label", "n", "b").distinct().collect():
        assert r["n"] == sizes[r["label"]]
        assert r["b"] == sum(v for k, v in sizes.items() if k < r["label"])


def test_global_rank_equals_row_number(spark):
    d = _data(spark).withColumn("v", F.col("k") % 17)
    got = global_rank(d, [F.col("v").desc(), F.col("k")], rank_col="rn", partitions=5)
    want = d.withColumn("rn2", F.row_number().over(Window.orderBy(F.col("v").desc(), "k")))
    assert got.join(want.select("k", "rn2"), "k").filter(F.col("rn") != F.col("rn2")).count() == 0
    assert got.count() == d.count()


def test_global_offsets_equal_running_sum(spark):
    d = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("w"))
    got = global_offsets(d, ["k"], "w", "off", partitions=6)
    rows = sorted(got.select("k", "w", "off").collect())
    acc = 0
    for r in rows:
        assert r["off"] == acc
        acc += r["w"]


def test_expand_counts(spark):
    small = spark.createDataFrame([(1, 0), (2, 5), (3, 250_001)], "g int, cnt long")
    out = expand_counts(small, "cnt", "j", block=100_000)
    agg = {r["g"]: (r["n"], r["lo"], r["hi"], r["d"]) for r in out.groupBy("g").agg(
        F.count("*").alias("n"), F.min("j").alias("lo"), F.max("j").alias("hi"), F.countDistinct("j").alias("d")).collect()}
    assert 1 not in agg
    assert agg[2] == (5, 1, 5, 5)
    assert agg[3] == (250_001, 1, 250_001, 250_001)


def test_global_rank_default_partitions_with_coalescing(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")  # AQE merges adjacent ranges of this small input
    try:
        d = _data(spark).withColumn("v", F.col("k") % 13)
        got = global_rank(d, [F.col("v"), F.col("k").desc()], rank_col="rn")
        want = d.withColumn("rn2", F.row_number().over(Window.orderBy("v", F.col("k").desc())))
        assert got.join(want.select("k", "rn2"), "k").filter(F.col("rn") != F.col("rn2")).count() == 0
        off = global_offsets(d, ["k"], "v", "off")
        rows = sorted(off.select("k", "v", "off").collect())
        acc = 0
        for r in rows:
            assert r["off"] == acc
            acc += r["v"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
