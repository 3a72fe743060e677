"""Properties of folds, samples, shards and batches (exact sizes, balance, invariance)."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from textprep.operators import sampling as B
from textprep.operators.folds import shuffled_folds, stratified_folds, tail_holdout


def labelled(spark, n=1003):
    # skewed classes: 0 holds ~70 %
    return spark.range(n).select(F.col("id").alias("index"),
                                 F.when(F.col("id") % 10 < 7, 0).when(F.col("id") % 10 < 9, 1).otherwise(2).cast("int").alias("label"))


def test_stratified_fold_sizes(spark):
    f = stratified_folds(labelled(spark), k=5).collect()
    per = Counter((r["label"], r["cv"]) for r in f)
    for lab in {r["label"] for r in f}:
        sizes = [per[(lab, c)] for c in range(5)]
        assert max(sizes) - min(sizes) <= 1
    overall = Counter(r["cv"] for r in f)
    assert max(overall.values()) - min(overall.values()) <= 1
    assert len(f) == 1003 and len({r["index"] for r in f}) == 1003


@pytest.mark.parametrize("parts", ["1", "4", "200"])
def test_folds_do_not_depend_on_partitioning(spark, parts):
    base = {r["index"]: r["cv"] for r in stratified_folds(labelled(spark)).collect()}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        other = {r["index"]: r["cv"] for r in stratified_folds(labelled(spark).repartition(int(parts))).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert base == other


def test_shuffled_folds_remainder_to_last(spark):
    f = Counter(r["cv"] for r in shuffled_folds(labelled(spark, 23), k=5).collect())
    assert [f[c] for c in range(5)] == [4, 4, 4, 4, 7]
    g = Counter(r["cv"] for r in shuffled_folds(labelled(spark, 3), k=5).collect())
    assert g == {4: 3}


def test_tail_holdout(spark):
    h = tail_holdout(labelled(spark, 50), "index", 7)
    valid = sorted(r["index"] for r in h.filter("split = 'valid'").collect())
    assert valid == list(range(43, 50))


@pytest.mark.parametrize("mode,per_class", [("downsampling", 100), ("upsampling", 703), (250, 250)])
def test_balanced_exact_counts(spark, mode, per_class):
    s = B.balanced_sample(labelled(spark), "label", "index", mode).collect()
    c = Counter(r["label"] for r in s)
    assert set(c.values()) == {per_class}
    for lab in c:
        js = sorted(r["j"] for r in s if r["label"] == lab)
        assert js == list(range(1, per_class + 1))
    if mode == "downsampling":  # without replacement: distinct rows
        assert len({r["index"] for r in s}) == len(s)


def test_dynamic_schedule(spark):
    t = B.dynamic_targets(labelled(spark), 80).collect()
    e0 = {r["label"]: r["target"] for r in t if r["epoch"] == 0}
    assert e0 == {0: 703, 1: 200, 2: 100} or all(abs(e0[k] - v) <= 1 for k, v in {0: 703, 1: 200, 2: 100}.items())
    last = {r["label"]: r["target"] for r in t if r["epoch"] == 79}
    assert set(last.values()) <= {100, 101}
    s = B.dynamic_sample(labelled(spark), 5, "label", "index").collect()
    t5 = {r["label"]: r["target"] for r in t if r["epoch"] == 5}
    assert Counter(r["label"] for r in s) == t5


def test_weighted_sample_balances(spark):
    from textprep.operators.labels import class_weights

    d = labelled(spark, 3000)
    s = B.weighted_sample(d, 6000, class_weights(d), "label", "index").collect()
    c = Counter(r["label"] for r in s)
    assert len(s) == 6000
    for v in c.values():
        assert abs(v / 6000 - 1 / 3) < 0.03


def test_shards_disjoint_equal_and_padded(spark):
    s = B.balanced_sample(labelled(spark), "label", "index", "downsampling")  # 300 draws
    sh = B.shard(s, 7).collect()
    assert len(sh) == 301  # padded to a multiple of 7 by repeating the head
    by = Counter(r["shard"] for r in sh)
    assert set(by.values()) == {43}
    assert sorted(r["pos"] for r in sh) == list(range(301))
    for r in sh:
        assert r["shard"] == r["pos"] % 7 and r["local_pos"] == r["pos"] // 7
    head = [r for r in sh if r["pos"] in (0, 300)]
    assert head[0]["index"] == head[1]["index"]


def test_batches_drop_last(spark):
    s = B.shard(B.balanced_sample(labelled(spark), "label", "index", "downsampling"), 7)
    b = B.batches(s, 10, drop_last=True).collect()
    assert len(b) == 7 * 40
    assert max(r["batch_id"] for r in b) == 3
    keep = B.batches(s, 10, drop_last=False).collect()
    assert len(keep) == 301


def test_weighted_rows_sample_matches_brute_force(spark):
    import bisect
    import hashlib

    rows = [(k, 1000.0 if k == 17 else float(k % 4)) for k in range(400)]  # one heavy row, zeros never drawn
    d = spark.createDataFrame(rows, "k long, w double")
    got = {r["j"]: r["k"] for r in B.weighted_rows_sample(d, 3000, "w", "k", seed=7, buckets=8).collect()}

    def md5(s):
        return hashlib.md5(s.encode()).hexdigest()

    order = sorted((md5(f"7|wrow|{k}"), k, w) for k, w in rows if w > 0)
    los, keys, acc = [], [], 0.0
    for _, k, w in order:
        los.append(acc)
        keys.append(k)
        acc += w
    want = {}
    for i in range(3000):
        x = int(md5(f"7|wdraw|0|{i}")[:8], 16) / 4294967296.0 * acc
        want[i + 1] = keys[bisect.bisect_right(los, x) - 1]
    assert got == want
    share = sum(1 for v in got.values() if v == 17) / 3000
    assert abs(share - 1000 / acc) < 0.03


def test_unshuffled_shard_and_ungrouped_batches(spark):
    s = B.balanced_sample(labelled(spark), "label", "index", "downsampling")
    sh = B.shard(s, 7, shuffle=False).collect()
    assert len(sh) == 301 and sorted(r["pos"] for r in sh) == list(range(301))
    first = min(sh, key=lambda r: r["pos"])
    assert (first["label"], first["j"]) == (0, 1)  # unshuffled: ordered by (label, j)
    b = B.batches(s.withColumn("p", F.col("j") - 1).filter("label = 0"), 30, drop_last=True, group_col=None, pos_col="p").collect()
    assert len(b) == 90 and max(r["batch_id"] for r in b) == 2
