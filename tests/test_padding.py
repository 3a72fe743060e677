"""Length buckets: the fewest pads, whole batches, masks."""

from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textprep.operators import padding as P
from textprep.operators import tokens as TK


def pads(lengths, counts, borders):
    return sum(c * (min(b for b in borders if b >= x) - x) for x, c in zip(lengths, counts))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 30), min_size=1, max_size=8), st.integers(1, 5))
def test_fewest_pads(histogram, buckets):
    x, n = np.array(list(histogram)), np.array(list(histogram.values()))
    borders, total = P.least_pads(x, n, buckets)
    assert total == pads(x, n, borders) and len(borders) <= buckets and borders[-1] == max(x) and borders == sorted(set(borders))
    every = [c + (max(x),) for k in range(buckets) for c in combinations(sorted(set(x) - {max(x)}), k)]
    assert total == min(pads(x, n, c) for c in every)


def test_batches(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.integers(1, 99, n).tolist(), [1] * n) for i, n in enumerate([0, 0, 1, 300] + [int(x) for x in r.exponential(20, 400)])] + [(999, None, None)]
    df = spark.createDataFrame(rows, "k int, ids array<int>, labels array<int>").withColumn("other", F.lit("x"))
    out = P.bucketed_batches(df, "ids", 16, ["k"], buckets=5, label_col="labels").collect()
    assert len(out) == len(rows)
    by = {i: ids or [] for i, ids, _ in rows}
    for b in {x["padded_len"] for x in out}:
        mine = [x for x in out if x["padded_len"] == b]
        assert sorted((x["batch_id"], x["in_batch"]) for x in mine) == [(i // 16, i % 16) for i in range(len(mine))]
        assert max(len(by[x["k"]]) for x in mine) == b
    for x in out:
        if x["ids"] is None:
            assert x["k"] == 999
            continue
        n, p = len(by[x["k"]]), x["padded_len"]
        assert x["ids"] == by[x["k"]] + [0] * (p - n) and x["labels"] == [1] * n + [-100] * (p - n) and x["attention_mask"] == [1] * n + [0] * (p - n)
    again = P.bucketed_batches(df, "ids", 16, ["k"], buckets=5, label_col="labels").collect()
    place = lambda rows: {(x["k"], x["batch_id"], x["in_batch"]) for x in rows}
    assert place(out) == place(again) != place(P.bucketed_batches(df, "ids", 16, ["k"], buckets=5, epoch=1).collect())


def test_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(P, "LENGTHS", 10)
    df = spark.range(1000).select(F.col("id").cast("int").alias("n"))
    borders = P.length_borders(df, "n", 4)
    assert borders[-1] == 999 and len(borders) == 4


def test_empty(spark):
    df = spark.createDataFrame([], "k int, ids array<int>")
    assert P.bucketed_batches(df, "ids", 4, ["k"]).collect() == []
    with pytest.raises(ValueError):
        P.length_borders(df.withColumn("n", F.size("ids")), "n", 0)


def test_text_ids_get_text_pads(spark):
    rows = [(0, [5, 6, 7]), (1, []), (2, [9]), (3, None)]
    df = spark.createDataFrame(rows, "k int, ids array<int>").withColumn("labels", F.col("ids"))
    text = df.select("k", *[F.col(c).cast("array<string>").alias(c) for c in ("ids", "labels")])
    one, two = (TK.pad_right(d, "ids", 5, TK.PAD_ID, "mask", "labels", TK.IGNORE_LABEL) for d in (df, text))
    assert [two.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels", "mask")] == ["string"] * 3
    strings = [F.size("ids")] + [TK.ids_string(c) for c in ("ids", "labels", "mask")]
    found = two.select("k", *strings).orderBy("k").collect()
    assert found == one.select("k", *strings).orderBy("k").collect()
    assert tuple(found[0])[1:] == (5, "5 6 7 0 0", "5 6 7 -100 -100", "1 1 1 0 0")
