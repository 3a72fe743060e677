"""Scoring and evaluation.

Predictions are a table ``(key, label, logits array<double>, pred)``, aligned by key, never by
position.  Every metric first reduces the predictions to a confusion table ``(label, pred, n)``
(partial aggregation; at most C x C rows), and everything after that runs on the tiny table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep.session import checkpointed, small_side


def argmax(logits) -> Column:
    """M1: index of the first maximum (0-based); ties go to the smaller class."""
    z = F.col(logits) if isinstance(logits, str) else logits
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def confusion(pred: DataFrame, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """M2: ``(label, pred, n)``."""
    return pred.groupBy(F.col(label_col).alias("label"), F.col(pred_col).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class(conf: DataFrame) -> DataFrame:
    """Per class over the union of true and predicted classes: support, predicted, hits,
    precision, recall, f1 (0 where undefined, as scikit-learn's report with zero division 0).
    Each confusion row counts for its label and for its prediction, in one grouping."""
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), zero.alias("predicted"), hit.cast("long").alias("tp")),
        F.struct(F.col("pred").alias("cls"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
    )
    t = conf.select(F.explode(sides).alias("s")).select("s.*").groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    prec = F.coalesce(F.try_divide(F.col("tp"), F.nullif(F.col("predicted"), F.lit(0))), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.nullif(F.col("support"), F.lit(0))), F.lit(0.0))
    f1 = F.coalesce(
        F.try_divide(2 * F.col("tp"), F.nullif(2 * F.col("tp") + (F.col("predicted") - F.col("tp")) + (F.col("support") - F.col("tp")), F.lit(0))),
        F.lit(0.0),
    )
    return t.select("cls", "support", "predicted", "tp", prec.cast("double").alias("precision"), rec.cast("double").alias("recall"), f1.cast("double").alias("f1"))


def classification_report(conf: DataFrame) -> DataFrame:
    """M3: rows per class (``row`` = class as text) plus ``accuracy``, ``macro avg`` and
    ``weighted avg`` rows, columns ``precision, recall, f1, support`` (the accuracy row carries
    the accuracy in ``f1`` and nulls in precision / recall, like the printed report)."""
    pc = checkpointed(per_class(conf))
    classes = pc.select(F.col("cls").cast("string").alias("row"), "precision", "recall", "f1", "support")
    tot = pc.agg(
        F.sum("support").alias("N"),
        F.sum("tp").alias("TP"),
        F.avg("precision").alias("mp"),
        F.avg("recall").alias("mr"),
        F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"),
    )
    acc = tot.select(
        F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
        (F.col("TP") / F.col("N")).alias("f1"), F.col("N").alias("support"),
    )
    macro = tot.select(F.lit("macro avg").alias("row"), F.col("mp").alias("precision"), F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("N").alias("support"))
    weighted = tot.select(
        F.lit("weighted avg").alias("row"), (F.col("wp") / F.col("N")).alias("precision"), (F.col("wr") / F.col("N")).alias("recall"),
        (F.col("wf") / F.col("N")).alias("f1"), F.col("N").alias("support"),
    )
    return classes.unionByName(acc).unionByName(macro).unionByName(weighted)


def report_rows(conf: DataFrame, num_classes: int) -> DataFrame:
    """M4: one row per class ``0..C-1`` (a class absent from both sides gets zeros)."""
    spark = conf.sparkSession
    pc = checkpointed(per_class(conf))
    return spark.range(num_classes).select(F.col("id").cast("int").alias("cls")).join(pc, "cls", "left").select(
        "cls", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("precision", "recall", "f1", "support")]
    )


def macro_metrics(conf: DataFrame) -> DataFrame:
    """M5: macro F1, precision, recall and accuracy (macro accuracy = macro recall) over the
    classes that occur (classes with tp + fp + fn = 0 are left out), plus micro accuracy."""
    pc = per_class(conf)
    return pc.agg(
        F.avg("f1").alias("f1"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("recall").alias("accuracy"),
        (F.sum("tp") / F.sum("support")).alias("micro_accuracy"),
    )


def _log_softmax_at(z: Column, y: Column) -> Column:
    m = F.array_max(z)
    lse = F.log(F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))) + m
    return lse - F.element_at(z, y + 1)


def cross_entropy(pred: DataFrame, logits_col: str = "logits", label_col: str = "label") -> DataFrame:
    """M6: mean over rows of ``logsumexp(z) - z[y]``."""
    return pred.agg(F.avg(_log_softmax_at(F.col(logits_col), F.col(label_col))).alias("loss"))


def weighted_cross_entropy(
    pred: DataFrame, weights: DataFrame, logits_col: str = "logits", label_col: str = "label"
) -> DataFrame:
    """M7: ``sum(w_y * ce) / sum(w_y)`` with a per-class weight table ``(label, w)``."""
    d = pred.join(small_side(weights.select(F.col("label").alias(label_col), "w")), label_col)
    ce = _log_softmax_at(F.col(logits_col), F.col(label_col))
    return d.agg((F.sum(F.col("w") * ce) / F.sum("w")).alias("loss"))


def soft_f1_loss(pred: DataFrame, num_classes: int, logits_col: str = "logits", label_col: str = "label", eps: float = 1e-7) -> DataFrame:
    """M8: softmax; soft tp / fp / fn per class; precision, recall and F1 with ``eps``; F1
    clamped to ``[eps, 1 - eps]``; loss = 1 - mean over all ``num_classes`` classes.

    A class's tp, fp and fn follow from sums of whole softmax vectors by label: tp is its own sum's entry, tp + fp the
    entry of all labels' sums, tp + fn the number of its rows.  So rows are never exploded by the classes; one
    vector per label is aggregated."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    z = F.col("_z")
    d = pred.select(F.col(label_col).alias("cls"), F.col(logits_col).alias("_z")).withColumn("_m", F.array_max(z))
    d = d.select("cls", F.transform(z, lambda x: F.exp(x - F.col("_m"))).alias("_e"))
    d = d.select("cls", "_e", F.aggregate("_e", F.lit(0.0), lambda a, b: a + b).alias("_s"))
    soft = array_to_vector(F.transform("_e", lambda x: x / F.col("_s")))
    per = d.where("_e IS NOT NULL AND cls IS NOT NULL").groupBy("cls").agg(Summarizer.sum(soft).alias("v"), F.count(F.lit(1)).alias("n"))
    per = checkpointed(per)  # a row per label
    total = per.agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("t")).withColumn("_one", F.lit(1))
    known = per.where((F.col("cls") >= 0) & (F.col("cls") < num_classes)).withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    tp = vector_to_array("v")[F.col("cls")]
    p, r = tp / (F.col("t")[F.col("cls")] + eps), tp / (F.col("n") + eps)
    f1 = F.least(F.greatest(2 * p * r / (p + r + eps), F.lit(eps)), F.lit(1 - eps))
    found = known.select(f1.alias("f1")).agg(F.coalesce(F.sum("f1"), F.lit(0.0)).alias("f"), F.count(F.lit(1)).alias("k"))
    # classes without rows have F1 = 0, clamped
    return found.select((1 - (F.col("f") + (num_classes - F.col("k")) * eps) / num_classes).alias("loss"))


def two_stage(stage1: DataFrame, stage2: DataFrame, key_col: str = "key") -> DataFrame:
    """Where stage 1 predicts a positive class, the final class is the stage-2
    prediction + 1; elsewhere 0.  ``stage1(key, pred)``, ``stage2(key, pred)`` joined by key."""
    s2 = stage2.select(key_col, F.col("pred").alias("_p2"))
    return stage1.join(s2, key_col, "left").withColumn(
        "final", F.when(F.col("pred") > 0, F.col("_p2") + 1).otherwise(F.lit(0)).cast("int")
    ).drop("_p2")


def stage2_rows(data: DataFrame, stage1: DataFrame, key_col: str = "key") -> DataFrame:
    """Rows that stage 1 predicts positive (semi-join on the key)."""
    return data.join(stage1.filter(F.col("pred") > 0).select(key_col), key_col, "left_semi")
