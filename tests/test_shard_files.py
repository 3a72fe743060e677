"""Shard files: layout, manifest, resuming, and readers that open no more than they need."""

import os

import pytest
from pyspark.sql import functions as F

from textprep.operators import sampling as B
from textprep.sources import shard_files as SF


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("run") / "shards")
    rows = spark.range(1003).select((F.col("id") % 7).alias("label"), F.col("id").alias("j"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    b = B.batches(B.shard(rows, 4), 8)
    SF.write_shards(b.select("shard", "batch_id", "in_batch", "text"), path, batches_per_part=5)
    return path, b.cache()


def in_order(rows):
    return sorted(tuple(r[c] for c in ("shard", "batch_id", "in_batch", "text")) for r in rows)


def test_one_sorted_file_for_each_part(spark, laid_out):
    path, _ = laid_out
    for r in SF.read_manifest(spark, path).collect():
        files = [f for f in os.listdir(f"{path}/shard={r['shard']}/part={r['part']}") if f.endswith(".parquet")]
        assert len(files) == 1
        places = [(x["batch_id"], x["in_batch"]) for x in spark.read.parquet(f"{path}/shard={r['shard']}/part={r['part']}/{files[0]}").collect()]
        assert places == sorted(places) and len(places) == r["rows"]
        assert (places[0][0], places[-1][0]) == (r["first_batch"], r["last_batch"])


@pytest.mark.parametrize("shard, batch", [(0, 0), (1, 7), (2, 10), (3, 31), (3, 32)])
def test_resume(spark, laid_out, shard, batch):
    path, b = laid_out
    want = b.where((F.col("shard") == shard) & (F.col("batch_id") >= batch))
    assert in_order(SF.read_from(spark, path, shard, batch).collect()) == in_order(want.collect())


def test_resume_opens_only_what_follows(spark, laid_out):
    path, _ = laid_out
    files = SF.read_from(spark, path, 1, 20).inputFiles()
    assert {f.split("shard=")[1].split("/")[0] for f in files} == {"1"}
    assert sorted(int(f.split("part=")[1].split("/")[0]) for f in files) == [4, 5, 6]


def test_position(spark, laid_out):
    path, _ = laid_out
    assert SF.position(spark, path, 2, 0) == (0, 0) and SF.position(spark, path, 2, 40) == (1, 0) and SF.position(spark, path, 2, 99) == (2, 19)
    assert SF.position(spark, path, 2, 10**6) is None


def test_unfinished_and_odd_layouts(spark, tmpdir_run):
    path = f"{tmpdir_run}/s"
    df = spark.createDataFrame([(0, 0, 0, "a"), (0, 0, 1, None)], "shard int, batch_id long, in_batch int, text string")
    SF.write_shards(df, path)
    os.rename(f"{path}/{SF.MANIFEST}", f"{tmpdir_run}/elsewhere")
    with pytest.raises(Exception):
        SF.read_from(spark, path, 0)
    with pytest.raises(ValueError, match="clash"):
        SF.write_shards(df.withColumn("part", F.lit(1)), f"{path}2")
    with pytest.raises(ValueError, match="one batch"):
        SF.write_shards(df, f"{path}3", batches_per_part=0)
    with pytest.raises(Exception):  # the folder is taken
        SF.write_shards(df, path)
