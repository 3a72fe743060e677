"""Features (E1-E8, G7-G9, T19): encoding chunks, collecting chunk vectors per document,
pooling, padding, a linear head and fitting one.

Per-document vector lists (E5) are one ``groupBy`` on the document key; pooling (E2/E3/E6) and
class means are ``Summarizer`` aggregates of whole vectors, combined partially before their one
shuffle, so no key gathers its chunks in one task.  A class-level model (one vector per class) is
a matrix that every task holds, with its class ids: predictions are classes, not positions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


RUN_ROWS = 512  # texts whose words a worker holds at a time


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- E5 / G7 / G8 / G9 --------------------------------------------------------------------------

def first_non_null(value, order) -> Column:
    """Value of the first row (by ``order``) whose value is not null (pandas ``first``)."""
    v, o = _c(value), _c(order)
    return F.min(F.when(v.isNotNull(), F.struct(o.alias("o"), v.alias("v"))))["v"]


def collect_chunks(
    chunks: DataFrame, key_col: str = "index", order_col: str = "subix", vec_col: str = "hs", first_cols=("label", "cv")
) -> DataFrame:
    """E5 = G7 + G8: one row per document with the first non-null ``label``/``cv``, the chunk
    vectors in chunk order (``hs``) and ``seq_len``."""
    firsts = [first_non_null(c, order_col).alias(c) for c in first_cols if c in chunks.columns]
    d = chunks.groupBy(key_col).agg(
        *firsts, F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(vec_col).alias("v")))).alias("_hs")
    )
    return d.withColumn(vec_col, F.transform("_hs", lambda s: s["v"])).withColumn("seq_len", F.size(vec_col).cast("int")).drop("_hs")


def max_seq_len(docs: DataFrame, seq_col: str = "seq_len") -> int:
    """G9 of collected documents: the longest sequence (a one-row aggregate)."""
    return docs.agg(F.max(seq_col)).first()[0] or 0


def longest_sequence(chunks: DataFrame, key_col: str = "index") -> DataFrame:
    """G9 of a chunk table, ``(max_seq_len)``: rows are counted per document, no vector moves."""
    return chunks.groupBy(key_col).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("max_seq_len"))


# --- E2 / E3 / E4 / E6: pooling -------------------------------------------------------------

def _dims(hs: Column) -> Column:
    return F.sequence(F.lit(0), F.size(F.element_at(hs, 1)) - 1)


def pool(hs, how: str = "mean") -> Column:
    """Pool a list of vectors (``array<array<double>>``) per dimension: ``mean``, ``sum`` or ``max``."""
    h = _c(hs)
    if how == "max":
        return F.transform(_dims(h), lambda i: F.array_max(F.transform(h, lambda v: v[i])))
    total = lambda i: F.aggregate(F.transform(h, lambda v: v[i]), F.lit(0.0), lambda a, x: a + x)
    if how == "sum":
        return F.transform(_dims(h), total)
    if how == "mean":
        return F.transform(_dims(h), lambda i: total(i) / F.size(h))
    raise ValueError(f"unknown pooling {how!r}")


def masked_mean(hs, mask) -> Column:
    """Mean over positions whose mask is 1 (the reference's pooling includes pads; this is the
    masked alternative)."""
    h, m = _c(hs), _c(mask)
    kept = F.filter(F.arrays_zip(h.alias("v"), m.alias("m")), lambda z: z["m"] == 1)
    return pool(F.transform(kept, lambda z: z["v"]), "mean")


def _summary(how: str, vec_col: str) -> Column:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    x = array_to_vector(F.transform(vec_col, lambda v: v.cast("double")))
    return vector_to_array({"mean": Summarizer.mean, "max": Summarizer.max, "sum": Summarizer.sum}[how](x)).alias(how)


def pool_by_key(chunks: DataFrame, key_col: str = "index", vec_col: str = "hs", hows=("mean",), also=()) -> DataFrame:
    """Per key the mean / max / sum vector of its chunk vectors.  The aggregate's
    buffer is one vector per pooling, merged in each task before the shuffle, so a key holding a third of all
    chunks costs no more than any other.  ``also``: further aggregates of the same grouping."""
    return chunks.groupBy(key_col).agg(*[_summary(h, vec_col) for h in hows], *also)


# --- T19: padding ---------------------------------------------------------------------------

def pad_sequences(docs: DataFrame, dim: int, vec_col: str = "hs", seq_col: str = "seq_len", to_len: int | None = None) -> DataFrame:
    """Pad every list of vectors with zero vectors to the longest sequence of the frame.
    Without ``to_len`` the frame is materialised first, so finding the longest sequence does
    not compute it twice."""
    if to_len is None:
        from textprep.session import checkpointed

        docs = checkpointed(docs)
    n = to_len if to_len is not None else max_seq_len(docs, seq_col)
    zero = F.array_repeat(F.lit(0.0), dim)
    pad = F.array_repeat(zero, F.greatest(F.lit(n) - F.col(seq_col), F.lit(0)))
    return docs.withColumn(vec_col, F.concat(F.col(vec_col), pad))


# --- class centroids, linear head (E7) and M1 --------------------------------------------

def class_means(df: DataFrame, vec_col: str = "hs", label_col: str = "label") -> DataFrame:
    """Per class the mean vector ``(cls, mean)``."""
    m = df.filter(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("cls")).agg(_summary("mean", vec_col))
    return m.select("cls", "mean")


def collect_model(model: DataFrame, vec_col: str = "mean", cls_col: str = "cls") -> list[tuple]:
    """A per-class model table as ``[(class, vector), ...]`` in class order: one vector per class, which
    every task that scores holds too."""
    return [(r[cls_col], list(r[vec_col])) for r in model.orderBy(cls_col).collect()]


def dot_scores(x, weights: list[list[float]], bias: list[float] | None = None, relu: bool = False, digits: int | None = 8) -> Column:
    """Scores of a vector against each row of a matrix (E7 when ``relu``), optionally rounded:
    ``[round(relu(x) . w_c + b_c, digits) for c]``; a matrix product per Arrow batch."""
    w = np.asarray(weights, np.float64).reshape(len(weights), -1)
    b = np.asarray(bias, np.float64) if bias is not None else np.zeros(len(weights))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        v = np.array(vectors.tolist(), np.float64)
        return pd.Series(list((np.maximum(v, 0) if relu else v) @ w.T + b))

    s = score(_c(x))
    return F.transform(s, lambda t: F.round(t, digits)) if digits is not None else s


def centroid_predictions(
    df: DataFrame, model_rows: list[tuple], vec_col: str = "hs", key_col: str = "key", label_col: str = "label", num_classes: int | None = None
) -> DataFrame:
    """Nearest-centroid scoring: ``logits`` are the dot products with the class means (8-digit
    rounding) in class order, ``pred`` is the class of the first arg-max (M1).  Logits are read by class
    in M6-M8: with ``num_classes`` they are laid out by class 0..C-1, a class without a mean at minus infinity."""
    from textprep.operators.metrics import argmax

    classes = [c for c, _ in model_rows]
    logits = dot_scores(F.col(vec_col), [v for _, v in model_rows])
    if num_classes is not None:
        place = {c: i for i, c in enumerate(classes)}
        d = df.withColumn("_z", logits)
        none = F.lit(float("-inf"))
        logits = F.array(*[F.col("_z")[place[c]] if c in place else none for c in range(num_classes)])
        classes = list(range(num_classes))
    else:
        d = df
    d = d.select(F.col(key_col).alias("key"), F.col(label_col).cast("int").alias("label"), logits.alias("logits"))
    return d.withColumn("pred", F.element_at(F.array(*[F.lit(c) for c in classes]), argmax("logits") + 1).cast("int"))


# --- E1: encoders ----------------------------------------------------------------------------

def hashed_bow(dim: int) -> Callable[[pd.Series], pd.Series]:
    """Built-in test encoder: counts of words per md5 bucket (``int(md5[:8], 16) % dim``)."""

    def count(texts: pd.Series, m: np.ndarray) -> None:
        words = texts.fillna("").str.split(" ")
        lens = words.str.len().to_numpy()
        flat = np.array(list(chain.from_iterable(words)), dtype=object)  # as objects: an array of text is as wide as its longest word
        codes, uniq = pd.factorize(flat)  # each distinct word of the run is hashed once
        ub = np.array([int(hashlib.md5(u.encode("utf-8")).hexdigest()[:8], 16) % dim if u else -1 for u in uniq], dtype=np.int64)
        b = ub[codes] if len(codes) else np.array([], dtype=np.int64)
        row = np.repeat(np.arange(len(texts)), lens)
        keep = b >= 0
        np.add.at(m, (row[keep], b[keep]), 1.0)

    def enc(texts: pd.Series) -> pd.Series:
        m = np.zeros((len(texts), dim), dtype=np.float64)
        for i in range(0, len(texts), RUN_ROWS):  # a worker holds the words of one run only
            count(texts.iloc[i : i + RUN_ROWS], m[i : i + RUN_ROWS])
        return pd.Series(list(m))

    return enc


def extract_features(
    chunks: DataFrame, encoder: Callable[[pd.Series], pd.Series], text_col: str = "data", out_col: str = "hs"
) -> DataFrame:
    """Apply a user-supplied batch encoder (text batch -> vector batch) to every chunk through
    Arrow batches (``pandas_udf``); the rest of the row stays in the JVM."""
    udf = F.pandas_udf(encoder, T.ArrayType(T.DoubleType()))
    return chunks.withColumn(out_col, udf(F.col(text_col)))


_MODELS: dict[str, Callable] = {}  # of a worker process


def _loaded(name: str, load: Callable[[], Callable]) -> Callable:
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def extract_with_model(
    chunks: DataFrame, name: str, load: Callable[[], Callable[[list[str]], np.ndarray]], text_col: str = "data", out_col: str = "hs", batch_size: int = 64
) -> DataFrame:
    """E1 with an encoder that is costly to load: ``load()`` returns it (texts -> rows of a matrix), and a worker process calls it
    once, under ``name``, however many tasks and batches it runs.  The texts of an Arrow batch are encoded ``batch_size`` at a time from
    the shortest to the longest, so a batch pads little, and their vectors go back to their rows; a null text has none."""

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from textprep.operators import features  # the process's own module, not this closure's copy of its names

        model = None
        for texts in batches:
            out = pd.Series([None] * len(texts), dtype=object)
            known = np.flatnonzero(texts.notna().to_numpy())
            order = known[np.argsort(texts.iloc[known].str.len().to_numpy(), kind="stable")]
            for a in range(0, len(order), batch_size):
                at = order[a : a + batch_size]
                model = model or features._loaded(name, load)
                for place, vector in zip(at, np.asarray(model(texts.iloc[at].tolist()), np.float64)):
                    out.iat[place] = vector.tolist()
            yield out

    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return chunks.withColumn(out_col, F.pandas_udf(encode, T.ArrayType(T.DoubleType()))(F.col(text_col)))


# --- E8: fitting a weighted linear head -------------------------------------------------------

def as_features(vec) -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(_c(vec))


def fit_linear_head(docs: DataFrame, vec_col: str = "x", label_col: str = "label", weight_col: str | None = "w", max_iter: int = 50):
    """Multinomial logistic regression on document vectors with per-row class weights
    (``pyspark.ml``); returns the fitted model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    d = docs.withColumn("_features", array_to_vector(vec_col)).withColumn("_label", F.col(label_col).cast("double"))
    lr = LogisticRegression(featuresCol="_features", labelCol="_label", family="multinomial", maxIter=max_iter, regParam=0.01, tol=1e-9)
    if weight_col:
        lr = lr.setWeightCol(weight_col)
    return lr.fit(d)


def predict_linear_head(model, docs: DataFrame, vec_col: str = "x") -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = docs.withColumn("_features", array_to_vector(vec_col))
    out = model.transform(d)
    return out.withColumn("logits", vector_to_array("rawPrediction")).withColumn("pred", F.col("prediction").cast("int")).drop(
        "_features", "rawPrediction", "probability", "prediction"
    )
