"""Python functions hold a run of rows at a time, whatever an Arrow batch holds."""

import tracemalloc
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from textprep.functions import text as X
from textprep.operators import features as E


def peak(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_runs_give_what_the_whole_gives():
    column = pa.array([None, "", "abc", "x" * 50, None, "y"] * 30, pa.string())
    for size in (1, 7, 100, 1 << 20):
        assert X.by_rows(lambda run: run, column, size).to_pylist() == column.to_pylist()
    assert X.by_rows(lambda run: run, column.slice(0, 0)).to_pylist() == []
    lists = pa.array([[1, 2], None, [], [3]] * 9, pa.list_(pa.int32())).slice(3)
    assert X.by_rows(lambda run: run, lists, 8).to_pylist() == lists.to_pylist()


def test_marks_of_odd_texts(spark):
    texts = [None, "", "plain", "e\u0301te\u0301 \u00e9", "\ud55c\uae00 \ufb01 \u2460", "\u0301"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", X.nfkd_strip_marks(F.col("s")).alias("s"))
    want = [None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts]
    assert [r["s"] for r in got.orderBy("i").collect()] == want


def test_one_long_word_costs_no_width():
    """Each word of a batch used to take the room of its longest word."""
    texts = pd.Series(["a b c d e"] * 2000 + ["w" * 20000, "", None])
    enc = E.hashed_bow(4)
    assert peak(lambda: enc(texts)) < 20 << 20
    m = np.array(enc(texts).tolist())
    assert m[:2000].sum(axis=1).tolist() == [5.0] * 2000 and m[2000:].sum(axis=1).tolist() == [1, 0, 0]


def test_words_of_runs_only():
    texts = pd.Series([" ".join(f"w{i}x{j}" for j in range(100)) for i in range(4000)])
    assert peak(lambda: E.hashed_bow(4)(texts)) < 16 << 20
