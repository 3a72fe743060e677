"""The best class by a stored model: broadcast or by blocks, many classes, ties, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textprep.operators.class_scoring import best_class


def frames(spark, x, w, classes):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, hs array<double>").repartition(3)
    return rows, spark.createDataFrame([(c, v.tolist()) for c, v in zip(classes, w)], "cls long, mean array<double>").repartition(4)


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_against_numpy(spark, max_bytes):
    g = np.random.default_rng(1)
    x, w = g.normal(size=(300, 6)), np.round(g.normal(size=(40, 6)), 1)
    w[7], w[30] = w[3], w[3]  # equal scores: the smallest class
    classes = [5 * i - 20 for i in range(40)]
    rows, model = frames(spark, x, w, classes)
    odd = spark.createDataFrame([(900, None)], rows.schema)
    model = model.unionByName(spark.createDataFrame([(999, None), (None, [0.0] * 6)], model.schema))
    got = {r["key"]: (r["score"], r["pred"]) for r in best_class(rows.unionByName(odd), model, max_bytes=max_bytes).collect()}
    scores = np.round(x @ w.T, 8)
    assert got.keys() == set(range(300))
    for i in range(300):
        assert got[i] == (pytest.approx(scores[i].max()), classes[int(scores[i].argmax())])


def test_100_000_classes_under_a_low_limit(spark):
    n = 100_000
    model = spark.range(n).select(F.col("id").alias("cls"), F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 0.37)).alias("mean"))
    rows = spark.range(50).select(F.col("id").alias("key"), F.array(F.cos(F.col("id") * 1.3), F.sin(F.col("id") * 0.7), F.lit(0.5)).alias("hs"))
    got = {r["key"]: r["pred"] for r in best_class(rows, model, max_bytes=1000).collect()}
    i = np.arange(n)
    w = np.stack([np.sin(i), np.cos(i), np.sin(i * 0.37)], axis=1)
    x = np.array([[np.cos(k * 1.3), np.sin(k * 0.7), 0.5] for k in range(50)])
    scores = np.round(x @ w.T, 8)
    assert len(got) == 50 and all(scores[k, got[k]] == pytest.approx(scores[k].max(), abs=2e-8) for k in range(50))


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_empty(spark, max_bytes):
    rows, model = frames(spark, np.ones((3, 2)), np.ones((2, 2)), [1, 2])
    assert best_class(rows, model.limit(0), max_bytes=max_bytes).collect() == []
    assert best_class(rows.limit(0), model, max_bytes=max_bytes).collect() == []
    assert {r["pred"] for r in best_class(rows, model, max_bytes=max_bytes, relu=True).collect()} == {1}
