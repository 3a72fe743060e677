"""The cache under races, dead writers and lost files."""

import json
import os
import subprocess
import sys

import pytest

from textprep.sources.cache import MANIFEST, cached_copy, materialise_once

WRITER = """
import os, sys, time
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from textprep.sources.cache import materialise_once
path, me, barrier = sys.argv[1:]
def compute():
    open(os.path.join(barrier, me), "w").close()
    while len(os.listdir(barrier)) < 2:  # both applications have found no copy
        time.sleep(0.05)
    return spark.range(100).selectExpr("id", "'" + me + "' AS writer").repartition(3)
print("RESULT", sorted(set(r.writer for r in materialise_once(spark, path, compute).collect())), len(os.listdir(path)))
"""


def names(path):
    return sorted(n for n in os.listdir(path) if not n.startswith("."))


def test_two_applications_race(tmpdir_run):
    from conftest import ROOT

    path, barrier = os.path.join(tmpdir_run, "table"), os.path.join(tmpdir_run, "barrier")
    os.mkdir(barrier)
    code = WRITER.format(root=ROOT)
    runs = [subprocess.Popen([sys.executable, "-c", code, path, me, barrier], stdout=subprocess.PIPE, text=True) for me in ("one", "two")]
    said = [[x for x in r.communicate(timeout=240)[0].splitlines() if x.startswith("RESULT")][0] for r in runs]
    with open(os.path.join(path, MANIFEST)) as f:
        copy = json.load(f)["copy"]
    assert copy in names(path)
    assert all("['one']" in x or "['two']" in x for x in said)  # each read one whole copy


def test_the_second_writer_reads_the_first_copy(spark, tmpdir_run):
    path = os.path.join(tmpdir_run, "table")

    def slow():
        first = materialise_once(spark, path, lambda: spark.range(3))  # published while we compute
        assert first.count() == 3
        return spark.range(10, 15)

    assert sorted(r.id for r in materialise_once(spark, path, slow).collect()) == [0, 1, 2]
    assert len(names(path)) == 2  # one copy, its manifest: the loser's copy is gone


def test_a_dead_writer_is_not_read(spark, tmpdir_run):
    path = os.path.join(tmpdir_run, "table")
    spark.range(99).write.parquet(os.path.join(path, "copy-dead"))

    def fail():
        raise RuntimeError("died")

    with pytest.raises(RuntimeError, match="died"):
        materialise_once(spark, path, fail)
    assert cached_copy(spark, path) is None
    assert materialise_once(spark, path, lambda: spark.range(4)).count() == 4


def test_lost_files_are_noticed(spark, tmpdir_run):
    path = os.path.join(tmpdir_run, "table")
    materialise_once(spark, path, lambda: spark.range(100).repartition(4))
    copy = cached_copy(spark, path)
    lost = next(n for n in os.listdir(copy) if n.startswith("part-"))
    os.remove(os.path.join(copy, lost))
    with pytest.raises(RuntimeError, match="manifest"):
        materialise_once(spark, path, lambda: spark.range(1))
