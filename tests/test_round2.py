"""Class ids, guards, wide random numbers, vocabulary paths, the cache across applications."""

import subprocess
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import ROOT
from textprep.functions.hashing import uniform
from textprep.operators import features as E
from textprep.operators import labels as L
from textprep.operators import sampling as B
from textprep.operators import tokens as TK
from textprep.operators.folds import stratified_folds


def test_predicted_classes_are_class_ids(spark):
    rows = [(1, 3, [1.0, 0.0]), (2, 7, [0.0, 1.0]), (3, 7, [0.1, 0.9]), (4, 3, [0.9, 0.2])]
    d = spark.createDataFrame(rows, "key long, label int, hs array<double>")
    model = E.collect_model(E.class_means(d, "hs", "label"))
    assert [c for c, _ in model] == [3, 7]
    assert {r["key"]: r["pred"] for r in E.centroid_predictions(d, model).collect()} == {1: 3, 2: 7, 3: 7, 4: 3}


def test_fold_without_a_class(spark):
    """A training fold that lacks class 1: classes keep their ids, its logit is minus infinity."""
    train = spark.createDataFrame([(0, [1.0, 0.0]), (2, [0.0, 1.0])], "label int, hs array<double>")
    model = E.collect_model(E.class_means(train, "hs", "label"))
    valid = spark.createDataFrame([(1, 2, [0.0, 2.0]), (2, 1, [1.0, 0.1])], "key long, label int, hs array<double>")
    got = {r["key"]: r for r in E.centroid_predictions(valid, model, num_classes=3).collect()}
    assert got[1]["pred"] == 2 and got[2]["pred"] == 0
    assert got[1]["logits"] == [0.0, float("-inf"), 2.0]


def test_uniform_hits_a_huge_range_evenly(spark):
    d = spark.range(50_000).select(F.floor(uniform(1, "id") * F.lit(float(1 << 40))).cast("long").alias("x"))
    n = [r["count"] for r in d.groupBy(F.pmod("x", F.lit(256))).count().collect()]
    assert len(n) == 256 and min(n) > 100 and max(n) < 320


def test_folds_need_a_class_of_k_rows(spark):
    d = spark.createDataFrame([(1, 0), (2, 1)], "index long, label int")
    with pytest.raises(ValueError):
        stratified_folds(d, k=5)
    assert stratified_folds(d, k=5, check=False).count() == 2


def test_folds_carry_other_columns(spark):
    d = spark.range(40).select(F.col("id").alias("index"), (F.col("id") % 2).cast("int").alias("label"), F.lit("t").alias("text"))
    got = stratified_folds(d)
    assert got.columns == ["index", "label", "text", "cv"] and got.count() == 40


def test_dynamic_schedule_checks(spark):
    d = spark.range(30).select((F.col("id") % 3).cast("int").alias("label"), "id")
    with pytest.raises(ValueError):
        B.dynamic_targets(d, 2, mode="upsampling")
    with pytest.warns(UserWarning, match="smallest class"):
        B.dynamic_targets(d, 2)


def test_label_domain_raises_on_request(spark):
    d = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 5), ("b", None)], "split string, label int")
    assert {r["split"]: r["ok"] for r in L.label_domain_report(d, 2, "split").collect()} == {"a": True, "b": False}
    with pytest.raises(ValueError, match="b"):
        L.label_domain_report(d, 2, "split", raise_on_violation=True)
    assert {(r["label"], r["n"]) for r in L.label_violations(d, 2, "split").collect()} == {(5, 1), (None, 1)}
    assert not L.label_domain_report(d.filter("split = 'a'"), 2, "split", n_weights=3).first()["ok"]


def test_large_vocabulary_paths(spark):
    """The joins that take over beyond the byte limit give what the copies give."""
    d = spark.createDataFrame([(1, "b a a zz"), (2, ""), (3, None), (4, "c " * 20)], "doc_id long, text string")
    vocab = TK.build_vocab(spark.createDataFrame([("a b c a",)], "text string"), "text")
    for options in ({}, {"max_len": 3}, {"padding": False}, {"add_special_tokens": True}):
        small = TK.encode_corpus(d, vocab, ["doc_id"], "text", **options).orderBy("doc_id").collect()
        assert small == TK.encode_corpus(d, vocab, ["doc_id"], "text", max_bytes=0, **options).orderBy("doc_id").collect()
    s = spark.createDataFrame([(1, ["a b", "zz"], "x"), (2, [], "y"), (3, None, "z")], "doc_id long, sents array<string>, other string")
    small = TK.encode_sentences(s, vocab, "doc_id").orderBy("doc_id").collect()
    assert small == TK.encode_sentences(s, vocab, "doc_id", max_bytes=0).orderBy("doc_id").collect()
    assert [r["toks"] for r in small] == [[[5, 6], [1]], [], []]
    ids = spark.createDataFrame([(5,), (99,)], "id int")
    assert {(r["id"], r["token"]) for r in TK.lookup_tokens(ids, vocab, max_bytes=0).collect()} == {(5, "a"), (99, None)}


def test_large_vocabulary_takes_odd_rows(spark, monkeypatch):
    """Part of the vocabulary copied, part joined; keys that repeat or are null; tokens that repeat; nulls among the words."""
    monkeypatch.setattr(TK, "HEAD_BYTES", 60)
    d = spark.createDataFrame([(1, "b a a zz"), (1, "c b zz yy c"), (None, "d e"), (None, "e c c"), (2, None), (3, "e " * 9 + "zz d")], "doc_id long, text string")
    vocab = spark.createDataFrame([("[PAD]", 0), ("[UNK]", 1), ("a", 2), ("b", 3), ("c", 4), ("d", 5), ("e", 6), ("e", 7)], "token string, id long")
    assert 0 < TK._cutoff(vocab, 60) < 7
    rows = lambda df: sorted(map(str, df.collect()))
    for max_bytes in (0, 100):
        assert rows(TK.encode_corpus(d, vocab, ["doc_id"], "text", max_bytes=max_bytes)) == rows(TK.encode_corpus(d, vocab, ["doc_id"], "text"))
        s = d.select("doc_id", F.array("text", F.lit("c a zz"), F.lit(None), F.lit("")).alias("sents"), F.lit("x").alias("other"))
        assert rows(TK.encode_sentences(s, vocab, "doc_id", max_bytes=max_bytes)) == rows(TK.encode_sentences(s, vocab, "doc_id"))
        ids = spark.createDataFrame([(2,), (2,), (5,), (99,), (None,)], "id int")
        assert rows(TK.lookup_tokens(ids, vocab, max_bytes=max_bytes)) == rows(TK.lookup_tokens(ids, vocab))


def test_large_vocabulary_moves_only_rare_words(spark, monkeypatch):
    monkeypatch.setattr(TK, "HEAD_BYTES", 60)
    vocab = spark.createDataFrame([("[PAD]", 0), ("a", 1), ("b", 2), ("c", 3), ("d", 4)], "token string, id long")
    d = spark.createDataFrame([(i, "a " * 500 + "d") for i in range(20)], "doc_id long, text string").repartition(2)
    out = TK.encode_corpus(d, vocab, ["doc_id"], "text", padding=False, max_bytes=100)
    assert all(r["input_ids"] == [1] * 500 + [4] for r in out.collect())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "map_from_entries" not in plan


def test_vocabulary_file_round_trip(spark, tmpdir_run):
    vocab = spark.createDataFrame([(f"t{i}", i) for i in range(50)], "token string, id long")
    TK.write_vocab(vocab.repartition(3), f"{tmpdir_run}/v")
    assert {(r["token"], r["id"]) for r in TK.read_vocab(spark, f"{tmpdir_run}/v").collect()} == {(f"t{i}", i) for i in range(50)}
    with open(f"{tmpdir_run}/one.txt", "w") as f:
        f.write("a\n b \na\n")
    assert {(r["token"], r["id"]) for r in TK.read_vocab(spark, f"{tmpdir_run}/one.txt").collect()} == {("a", 2), ("b", 1)}


CACHE = """
import sys
sys.path.insert(0, {root!r})
from textprep.session import build_session
from textprep.sources.io import cached_path, with_cache
spark = build_session(master="local[2]", shuffle_partitions=2)
ran = []
def compute():
    ran.append(1)
    return spark.range(5)
n = with_cache(spark, cached_path({folder!r}, dict(a=1)), compute).count()
print("RAN", len(ran), n)
"""


def test_a_second_application_reads_the_first_ones_table():
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    said = [
        subprocess.run([sys.executable, "-c", CACHE.format(root=ROOT, folder=folder)], capture_output=True, text=True, timeout=120).stdout
        for _ in range(2)
    ]
    assert [s.split("RAN ")[1].split() for s in said] == [["1", "5"], ["0", "5"]]
