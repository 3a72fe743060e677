"""E7, M1 by a stored model: the best class of every vector, however many classes there are.

The model stays a table ``(cls, mean)``.  Its bytes are counted: within the limit every task gets a copy; beyond it classes are packed into blocks
of a matrix each, vectors into batches, and every batch meets every block in a join on the block (a stated set of rows against all classes, in blocks).
A block returns one candidate for each vector; the best of them is an aggregate that combines in each task before it is shuffled.  No class
table reaches the driver, and no row holds all scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textprep.session import checkpointed, shuffle_partitions

MODEL_BYTES = 64 << 20  # of a model that every task may hold a copy of
BLOCK_CLASSES = 4096
BATCH_ROWS = 1024


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _best(x: np.ndarray, w: np.ndarray, classes: np.ndarray, relu: bool, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector the highest score and its class, the smallest class of equal scores; ``classes`` ascend."""
    scores = np.round((np.maximum(x, 0) if relu else x) @ w.T, digits)
    at = scores.argmax(axis=1)
    return scores[np.arange(len(x)), at], classes[at]


def best_class(df: DataFrame, model: DataFrame, vec_col: str = "hs", key_col: str = "key", relu: bool = False, digits: int = 8,
               max_bytes: int = MODEL_BYTES) -> DataFrame:
    """``(key, score, pred)``: the class of the highest dot product with a class vector (``model (cls, mean)``), rounded to ``digits``; of equal
    scores the smallest class.  Vectors and class vectors that are null take no part; an empty model gives no rows."""
    spark = df.sparkSession
    rows = df.select(F.col(key_col).alias("key"), F.col(vec_col).cast("array<double>").alias("x")).where("x IS NOT NULL")
    model = checkpointed(model.select(F.col("cls").cast("long"), F.col("mean").cast("array<double>")).dropna())
    size, n = model.agg(F.coalesce(F.sum(8 * F.size("mean") + 8), F.lit(0)), F.count(F.lit(1))).first()
    key = rows.schema["key"].dataType.simpleString()
    schema = f"key {key}, score double, pred long"
    if not n:
        return spark.createDataFrame([], schema)

    if size <= max_bytes:
        table = sorted((r["cls"], r["mean"]) for r in model.collect())
        shared = spark.sparkContext.broadcast((np.array([c for c, _ in table]), np.array([m for _, m in table], np.float64)))

        def run(batches):
            import pyarrow as pa

            classes, w = shared.value
            for batch in batches:
                if batch.num_rows:
                    score, pred = _best(_matrix(batch.column(1)), w, classes, relu, digits)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(pred)], names=["key", "score", "pred"])

        return rows.mapInArrow(run, schema)

    def pack_classes(table):
        import pyarrow as pa

        table = table.sort_by("cls").combine_chunks()
        w = _matrix(table.column("mean").chunk(0))
        return pa.table({"block": table.column("block").slice(0, 1), "classes": [table.column("cls").to_numpy().tobytes()], "weights": [w.tobytes()]})

    def pack_rows(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(a, BATCH_ROWS)
                keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([keys, pa.array([_matrix(part.column(1)).tobytes()], pa.binary())], names=["keys", "vectors"])

    def meet(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column("keys")[i].values
                classes = np.frombuffer(batch.column("classes")[i].as_py(), np.int64)
                x = np.frombuffer(batch.column("vectors")[i].as_py()).reshape(len(keys), -1)
                w = np.frombuffer(batch.column("weights")[i].as_py()).reshape(len(classes), -1)
                score, pred = _best(x, w, classes, relu, digits)
                yield pa.RecordBatch.from_arrays([keys, pa.array(score), pa.array(pred)], names=["key", "score", "pred"])

    n_blocks, tasks = -(-n // BLOCK_CLASSES), shuffle_partitions(spark)
    block = F.pmod(F.xxhash64("cls"), F.lit(n_blocks)).cast("int")
    blocks = model.withColumn("block", block).groupBy("block").applyInArrow(pack_classes, "block int, classes binary, weights binary")
    packed = rows.mapInArrow(pack_rows, f"keys array<{key}>, vectors binary")
    packed = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).repartition(tasks, "block", F.xxhash64("vectors"))
    found = packed.join(blocks, "block").select("keys", "vectors", "classes", "weights").mapInArrow(meet, schema)
    top = found.groupBy("key").agg(F.max(F.struct("score", (-F.col("pred")).alias("less"))).alias("top"))
    return top.select("key", F.col("top.score").alias("score"), (-F.col("top.less")).alias("pred"))
