"""E1 with a costly encoder: loads per worker, order of rows, batches by length."""

import os

from pyspark.sql import functions as F

from textprep.operators import features as E


def loader(folder):
    def load():
        import os
        import uuid

        import numpy as np

        open(os.path.join(folder, f"load-{os.getpid()}-{uuid.uuid4().hex}"), "w").close()

        def model(texts):
            lens = sorted(map(len, texts))
            assert [len(t) for t in texts] == lens and len(texts) <= 16  # by length, in batches
            with open(os.path.join(folder, f"batch-{uuid.uuid4().hex}"), "w") as f:
                f.write(f"{lens[0]} {lens[-1]}")
            return np.array([[len(t), t.count("a")] for t in texts])

        return model

    return load


def test_loaded_once_per_worker(spark, tmpdir_run):
    rows = [(i, "a" * (i * 37 % 101) + "b" * (i % 5)) for i in range(1000)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "k int, data string").repartition(24)  # many more tasks than workers
    got = {r["k"]: r["hs"] for r in E.extract_with_model(df, tmpdir_run, loader(tmpdir_run), batch_size=16).collect()}
    assert got == {k: None if t is None else [float(len(t)), float(t.count("a"))] for k, t in rows}
    E.extract_with_model(df, tmpdir_run, loader(tmpdir_run), batch_size=16).agg(F.count("hs")).collect()  # a second query, same workers
    loads = [n.split("-")[1] for n in os.listdir(tmpdir_run) if n.startswith("load-")]
    assert len(loads) == len(set(loads)) <= 8  # a load for each process, 4 cores
    assert sum(n.startswith("batch-") for n in os.listdir(tmpdir_run)) > len(loads)


def test_empty_frame(spark, tmpdir_run):
    df = spark.createDataFrame([], "k int, data string")
    assert E.extract_with_model(df, tmpdir_run, loader(tmpdir_run)).collect() == []
    nulls = spark.createDataFrame([(1, None)], "k int, data string")
    assert E.extract_with_model(nulls, "never loaded", loader(tmpdir_run)).first()["hs"] is None
    assert os.listdir(tmpdir_run) == []
