"""E8 and M11 over all folds: k weighted softmax models, each fitted without its fold, in the same passes over the rows.

A pass gives the losses and gradients of all models at their present points: a task multiplies its rows with all k weight matrices
and skips for each model the rows of its fold; partial sums are added up in groups of tasks before they reach the driver, which holds
k * classes * (dim + 1) numbers and their last few steps (L-BFGS, each model with its own line search; a model that is done no
longer moves).  Then one pass scores every row by the model that has not seen it.

The objective is the weighted mean of the cross entropy plus ``l2 / 2`` times the squared weights; intercepts are free.  Rows without
vector, label, weight or fold take no part."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Generator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_BYTES = 256 << 20  # of all models, which the driver and every task hold
MEMORY = 10  # steps that L-BFGS remembers


def _arrays(batch, columns: int):
    """Vectors with a 1 at their end, and the other columns, of an Arrow batch."""
    n = batch.num_rows
    flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
    x = np.ones((n, len(flat) // max(n, 1) + 1))
    if n:
        x[:, :-1] = flat.reshape(n, -1)
    return x, *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, columns))


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = z.max(axis=1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(axis=1, keepdims=True)
    return e / total, (top + np.log(total))[:, 0]


def _partial(shared, folds: int):
    """Of a task's rows: each model's sums of losses, weights and gradients."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        points = shared.value
        k, classes, width = points.shape
        sums = np.zeros((k, 2 + classes * width))
        for batch in batches:
            x, y, w, cv = _arrays(batch, 4)
            for f in range(k):
                mine = cv != f
                if not mine.any():
                    continue
                xs, ys, ws = x[mine], y[mine], w[mine]
                z = xs @ points[f].T
                p, lse = _softmax(z)
                rows = np.arange(len(ys))
                sums[f, 0] += (ws * (lse - z[rows, ys])).sum()
                sums[f, 1] += ws.sum()
                p[rows, ys] -= 1
                sums[f, 2:] += ((p * ws[:, None]).T @ xs).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["task", "sums"])

    return run


def _added(table):
    import pyarrow as pa

    total = np.add.reduce([np.frombuffer(v.as_py(), np.float64) for v in table.column("sums")])
    return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})


def _lbfgs(x: np.ndarray, max_iter: int, tol: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Yields points, is sent (value, gradient) there, returns the minimum."""
    value, grad = yield x
    steps: deque = deque(maxlen=MEMORY)
    for _ in range(max_iter):
        if np.abs(grad).max(initial=0) <= tol:
            break
        d, used = -grad.copy(), []
        for s, g, r in reversed(steps):
            a = r * (s @ d)
            used.append(a)
            d -= a * g
        if steps:
            s, g, _ = steps[-1]
            d *= (s @ g) / (g @ g)
        for (s, g, r), a in zip(steps, reversed(used)):
            d += (a - r * (g @ d)) * s
        slope = grad @ d
        if slope >= 0:
            steps.clear()
            d, slope = -grad, -(grad @ grad)
        low, high, t = 0.0, math.inf, 1.0 if steps else min(1.0, 1 / np.abs(grad).sum())
        for _ in range(30):  # until value and slope both fall enough
            new, new_grad = yield x + t * d
            if new > value + 1e-4 * t * slope:
                high = t
            elif new_grad @ d < 0.9 * slope:
                low = t
            else:
                break
            t = 2 * low if high == math.inf else (low + high) / 2
        step, change = t * d, new_grad - grad
        if new >= value and np.abs(step).max(initial=0) < 1e-14:
            break
        if step @ change > 1e-12:
            steps.append((step, change, 1 / (step @ change)))
        x, value, grad = x + step, new, new_grad
    return x


def fit_folds(rows: DataFrame, folds: int, vec_col: str = "x", label_col: str = "label", weight_col: str | None = "w", fold_col: str = "cv",
              l2: float = 0.01, max_iter: int = 100, tol: float = 1e-7) -> tuple[list, np.ndarray, int]:
    """``(classes, weights, passes)``: the labels in order, an array (fold, class, dim + 1) whose last column has the intercepts, and
    how often the rows were read."""
    from textprep.session import checkpointed

    spark = rows.sparkSession
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    d = rows.select(F.col(vec_col).cast("array<double>").alias("x"), F.col(label_col).alias("y"), weight.alias("w"), F.col(fold_col).cast("int").alias("cv"))
    d = checkpointed(d.dropna())
    size = d.agg(F.max(F.size("x")).alias("most"), F.min(F.size("x")).alias("least"), F.approx_count_distinct("y").alias("c")).first()
    if size["most"] is None:
        raise ValueError("no rows to learn from")
    if size["most"] != size["least"]:
        raise ValueError("vectors differ in length")
    width = size["most"] + 1
    if folds * size["c"] * width * 8 > MODEL_BYTES:
        raise ValueError(f"the models take more than {MODEL_BYTES} bytes")
    classes = sorted(r["y"] for r in d.select("y").distinct().collect())
    place = F.create_map(*[F.lit(v) for i, c in enumerate(classes) for v in (c, i)])
    d = checkpointed(d.withColumn("y", place[F.col("y")].cast("long")))
    groups = max(1, math.isqrt(d.rdd.getNumPartitions()))
    shape = (len(classes), width)

    searches = [_lbfgs(np.zeros(shape).ravel(), max_iter, tol) for _ in range(folds)]
    points, done, passes = [next(s) for s in searches], [None] * folds, 0
    while any(x is None for x in done):
        at = np.stack([points[f] if done[f] is None else done[f] for f in range(folds)]).reshape(folds, *shape)
        shared = spark.sparkContext.broadcast(at)
        parts = d.mapInArrow(_partial(shared, folds), "task int, sums binary")
        parts = parts.groupBy(F.pmod("task", F.lit(groups)).alias("group")).applyInArrow(_added, "sums binary")
        sums = np.add.reduce([np.frombuffer(r["sums"], np.float64) for r in parts.collect()]).reshape(folds, -1)
        shared.destroy()
        passes += 1
        for f in range(folds):
            if done[f] is not None:
                continue
            mass = sums[f, 1]
            if mass == 0:  # all rows are in this fold
                done[f] = np.zeros(shape).ravel()
                continue
            free = at[f].copy()
            free[:, -1] = 0
            value = sums[f, 0] / mass + l2 / 2 * (free * free).sum()
            try:
                points[f] = searches[f].send((value, sums[f, 2:] / mass + l2 * free.ravel()))
            except StopIteration as end:
                done[f] = end.value
    return classes, np.stack(done).reshape(folds, *shape), passes


def score_held_out(rows: DataFrame, classes: list, weights: np.ndarray, key_col: str = "key", vec_col: str = "x", label_col: str = "label",
                   fold_col: str = "cv") -> DataFrame:
    """``(key, label, cv, logits, pred)``: every row scored by the model of its fold, in one pass."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    d = rows.select(F.col(vec_col).cast("array<double>").alias("x"), F.col(fold_col).cast("int").alias("cv"), F.col(key_col).alias("key"), F.col(label_col).alias("label"))
    d = d.where("x IS NOT NULL AND cv IS NOT NULL")
    key, label = (d.schema[c].dataType.simpleString() for c in ("key", "label"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, cv = _arrays(batch, 2)
            logits = np.zeros((len(x), len(classes)))
            for f in np.unique(cv):
                logits[cv == f] = x[cv == f] @ shared.value[f].T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(classes), pa.int32()), pa.array(logits.ravel()))
            pred = pa.array([classes[i] for i in logits.argmax(axis=1).tolist()], batch.schema.field("label").type) if len(x) else pa.array([], batch.schema.field("label").type)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), batch.column(1), lists, pred], names=["key", "label", "cv", "logits", "pred"])

    return d.mapInArrow(run, f"key {key}, label {label}, cv int, logits array<double>, pred {label}")
