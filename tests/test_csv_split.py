"""Multi-line CSV by byte ranges against Python's reader and Spark's whole-file mode, with ranges that end anywhere."""

import csv
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textprep.sources import csv_split as CS
from textprep.sources import io as IO

SCHEMA = "index long, title string, goal string"


@pytest.fixture()
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "997", "spark.sql.files.openCostInBytes": "1", "spark.sql.shuffle.partitions": "4"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, rows, quoting=csv.QUOTE_MINIMAL, end="\n"):
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f, quoting=quoting, lineterminator=end)
        w.writerow(["index", "title", "goal"])
        w.writerows(rows)


def cells(r):
    kinds = ["plain", "two\nlines", 'a "quoted" word', 'ends "so"', '"', '""', "comma, here", '\n"\n"\n', "x" * 1500, "line\n" * 400, "한국어\n\"글\"", ",", '",\n"', "end\n"]
    return [(i, r.choice(kinds), r.choice(kinds)) for i in range(400)]


@pytest.mark.parametrize("quoting", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
def test_against_python(spark, small_ranges, tmpdir_run, quoting):
    rows = cells(random.Random(int(quoting)))
    path = os.path.join(tmpdir_run, "records.csv")
    write(path, rows, quoting)
    df = CS.read_records_split(spark, path, SCHEMA)
    assert sorted(map(tuple, df.collect())) == sorted(rows)
    ranges = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_block_start")).distinct().count()
    assert ranges > 50  # one file, many tasks; records of 2,000 bytes cross several ranges
    whole = IO.read_records(spark, path, SCHEMA)
    assert whole.exceptAll(df).count() == 0 and df.exceptAll(whole).count() == 0


def test_several_files_and_crlf(spark, small_ranges, tmpdir_run):
    a, b = cells(random.Random(5))[:150], [(1000 + i, t, g) for i, t, g in cells(random.Random(6))[:150]]
    write(os.path.join(tmpdir_run, "a.csv"), a)
    write(os.path.join(tmpdir_run, "b.csv"), b, end="\r\n")
    assert sorted(map(tuple, CS.read_records_split(spark, tmpdir_run, SCHEMA).collect())) == sorted(a + b)


def test_literal_quotes_empty_lines_nulls(spark, small_ranges, tmpdir_run):
    path = os.path.join(tmpdir_run, "x.csv")
    with open(path, "w") as f:
        f.write('index,title,goal\n1,5" disk,g\n\n2,,"a\n\nb"\n3,a "b" c,\n4,"",x')
    rows = sorted(map(tuple, CS.read_records_split(spark, path, SCHEMA).collect()))
    assert rows == sorted(map(tuple, IO.read_records(spark, path, SCHEMA).collect()))
    assert rows[:3] == [(1, '5" disk', "g"), (2, None, "a\n\nb"), (3, 'a "b" c', None)]


def test_only_header_and_bad_record(spark, tmpdir_run):
    path = os.path.join(tmpdir_run, "x.csv")
    write(path, [])
    assert CS.read_records_split(spark, path, SCHEMA).collect() == []
    with open(path, "a") as f:
        f.write("no number,a,b\n")
    with pytest.raises(Exception):
        CS.read_records_split(spark, path, SCHEMA).collect()


def test_test_schema(spark, tmpdir_run):
    path = os.path.join(tmpdir_run, "x.csv")
    with open(path, "w") as f:
        f.write("index,title\n1,t\n")
    assert CS.read_records_split(spark, path, "index long, title string, label int", is_test=True).columns == ["index", "title"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text(alphabet='a,"\n', max_size=6), min_size=2, max_size=3), max_size=5), st.sampled_from([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
def test_states_of_lines(rows, quoting):
    """Followed line by line, the state is closed exactly where Python's writer ends a record."""
    import io

    out = io.StringIO()
    w = csv.writer(out, quoting=quoting, lineterminator="\n")
    ends = []
    for row in rows:
        w.writerow(row)
        ends.append(out.getvalue().count("\n"))
    state, closed = False, []
    for i, line in enumerate(out.getvalue().split("\n")[:-1], 1):
        state = CS.ends_open(line, state)
        if not state:
            closed.append(i)
    assert closed == ends


def test_only_long_records_are_shuffled(spark, tmpdir_run):
    path = os.path.join(tmpdir_run, "x.csv")
    write(path, [(i, "plain", "cell") for i in range(100)])
    texts = CS.record_texts(spark, path, os.path.join(tmpdir_run, "lines"))
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("collect_list") == 1 and texts.count() == 101
