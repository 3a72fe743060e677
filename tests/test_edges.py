"""Edge cases: empty inputs, null labels, empty texts."""

from pyspark.sql import functions as F

from textprep.operators import clean as C
from textprep.operators import sampling as B
from textprep.operators import tokens as TK
from textprep.operators.chunks import explode_chunks
from textprep.operators.folds import stratified_folds


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "index long, label int, text string")
    assert stratified_folds(e).count() == 0
    assert B.balanced_sample(e, "label", "index", "upsampling").count() == 0
    assert B.shard(B.balanced_sample(e, "label", "index"), 3).count() == 0
    assert explode_chunks(e, 10, "text").count() == 0
    v = TK.build_vocab(spark.createDataFrame([("a b",)], "text string"), "text")
    assert TK.encode_corpus(e, v, ["index"], "text").count() == 0


def test_null_label_is_its_own_group(spark):
    d = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(50)], "index long, label int")
    f = stratified_folds(d, k=5).collect()
    assert len(f) == 50 and all(r["cv"] is not None for r in f)
    s = B.balanced_sample(d, "label", "index", "downsampling").collect()
    assert all(r["label"] is not None for r in s)  # null labels do not count as a class


def test_dedup_on_empty_and_all_null(spark):
    d = spark.createDataFrame([(1, None), (2, None)], "index long, k string")
    assert sorted(r["index"] for r in C.dedup_keep_first(d, ["k"]).collect()) == [1, 2]
    assert C.dedup_keep_first(d.filter("index > 5"), ["k"]).count() == 0


def test_empty_text_gives_one_empty_chunk(spark):
    d = spark.createDataFrame([(1, ""), (2, None)], "index long, data_cleaned string")
    rows = {r["index"]: r["data"] for r in explode_chunks(d, 5, carry=()).collect()}
    assert rows.get(1) == ""
