"""Queries: predictions and their evaluation.

The prediction table is nearest-class-centroid scoring of the ``embeddings`` vectors: the logit
of class c is the dot product with the mean vector of class c (8-digit rounding), ``pred`` is
the first arg-max."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep.operators import features as E
from textprep.operators import labels as L
from textprep.operators import metrics as M
from textprep.plans.catalog import register, rounded
from textprep.plans.q_features import MEANS_SQL, _bow_sql, centroid_model, docs
from textprep.plans.q_prep import _chunks_sql
from textprep.sources.tables import CHUNK_VECTORS_SQL, chunk_vectors

CV = CHUNK_VECTORS_SQL


def predictions(spark, sf_dir):
    c = chunk_vectors(spark, sf_dir)
    return E.centroid_predictions(c, centroid_model(spark, sf_dir), "hs", "vec_id", "label")


SCORES_SQL = f"""(SELECT e.vec_id AS key, e.label, m.cls, round(list_dot_product(e.hs, m.w), 8) AS s
    FROM {CV} e, {MEANS_SQL} m)"""
PRED_SQL = f"""(SELECT key, label, logits, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred
    FROM (SELECT key, label, list(s ORDER BY cls) AS logits FROM {SCORES_SQL} a GROUP BY key, label) b)"""


def _report_sql(pred: str = PRED_SQL) -> str:
    conf = f"(SELECT label, pred, count(*) AS n FROM {pred} p GROUP BY label, pred)"
    pc = f"""(SELECT coalesce(t.cls, q.cls) AS cls, coalesce(t.support, 0) AS support, coalesce(q.predicted, 0) AS predicted,
                  coalesce(h.tp, 0) AS tp
             FROM (SELECT label AS cls, sum(n) AS support FROM {conf} c GROUP BY label) t
             FULL OUTER JOIN (SELECT pred AS cls, sum(n) AS predicted FROM {conf} c GROUP BY pred) q ON t.cls = q.cls
             LEFT JOIN (SELECT label AS cls, n AS tp FROM {conf} c WHERE label = pred) h ON h.cls = coalesce(t.cls, q.cls))"""
    return f"""(SELECT cls, support, predicted, tp,
                  CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
                  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
                  CASE WHEN predicted + support > 0 THEN 2 * tp / (predicted + support) ELSE 0.0 END AS f1
             FROM {pc} z)"""


@register("m1_argmax", f"""SELECT CAST(key AS BIGINT) AS key, CAST(label AS BIGINT) AS label, CAST(pred AS BIGINT) AS pred,
    round(list_max(logits), 6) AS max_score, round(logits[1], 6) AS score_0 FROM {PRED_SQL} p""")
def q_m1(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return p.select(
        F.col("key").cast("long"), F.col("label").cast("long"), F.col("pred").cast("long"),
        rounded(F.array_max("logits"), "max_score"), rounded(F.col("logits")[0], "score_0"),
    )


@register("m1_argmax_by_blocks", f"""SELECT CAST(key AS BIGINT) AS key, CAST(pred AS BIGINT) AS pred, round(list_max(logits), 6) AS max_score FROM {PRED_SQL} p""")
def q_m1_blocks(spark, sf_dir):
    """M1 by a stored model that is not broadcast: vectors meet blocks of classes."""
    from textprep.operators.class_scoring import best_class

    c = chunk_vectors(spark, sf_dir)
    p = best_class(c, E.class_means(c), "hs", "vec_id", max_bytes=0)
    return p.select(F.col("key").cast("long"), F.col("pred").cast("long"), rounded("score", "max_score"))


@register("m2_confusion", f"""SELECT CAST(label AS BIGINT) AS label, CAST(pred AS BIGINT) AS pred, CAST(count(*) AS BIGINT) AS n
    FROM {PRED_SQL} p GROUP BY label, pred""")
def q_m2(spark, sf_dir):
    c = M.confusion(predictions(spark, sf_dir))
    return c.select(F.col("label").cast("long"), F.col("pred").cast("long"), F.col("n").cast("long"))


def _report_out_sql(pred: str = PRED_SQL) -> str:
    r = _report_sql(pred)
    return f"""SELECT CAST(cls AS VARCHAR) AS "row", round(precision, 6) AS precision, round(recall, 6) AS recall,
                      round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM {r} a
      UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM {r} b
      UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM {r} c
      UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM {r} d"""


def _report_out(rep):
    return rep.select(
        "row", rounded("precision", "precision"), rounded("recall", "recall"), rounded("f1", "f1"), F.col("support").cast("long")
    )


@register("m3_classification_report", _report_out_sql())
def q_m3(spark, sf_dir):
    return _report_out(M.classification_report(M.confusion(predictions(spark, sf_dir))))


@register("m4_report_rows", f"""SELECT CAST(g.cls AS BIGINT) AS cls, round(coalesce(precision, 0), 6) AS precision,
      round(coalesce(recall, 0), 6) AS recall, round(coalesce(f1, 0), 6) AS f1, CAST(coalesce(support, 0) AS BIGINT) AS support
    FROM (SELECT unnest(generate_series(0, 11)) AS cls) g LEFT JOIN {_report_sql()} r ON g.cls = r.cls""")
def q_m4(spark, sf_dir):
    r = M.report_rows(M.confusion(predictions(spark, sf_dir)), 12)
    return r.select(
        F.col("cls").cast("long"), rounded("precision", "precision"), rounded("recall", "recall"), rounded("f1", "f1"),
        F.col("support").cast("long"),
    )


def _macro_sql(pred: str) -> str:
    r = _report_sql(pred)
    return f"""SELECT round(avg(f1), 6) AS f1, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
                      round(avg(recall), 6) AS accuracy, round(sum(tp) / sum(support), 6) AS micro_accuracy FROM {r} a"""


def _macro_out(m):
    return m.select(*[rounded(c, c) for c in ("f1", "precision", "recall", "accuracy", "micro_accuracy")])


@register("m5_macro_metrics_chunks", _macro_sql(PRED_SQL))
def q_m5(spark, sf_dir):
    return _macro_out(M.macro_metrics(M.confusion(predictions(spark, sf_dir))))


DOC_PRED_SQL = f"""(SELECT key, label, logits, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred FROM
    (SELECT d."index" AS key, d.label, list(round(list_dot_product(d.v, m.w), 8) ORDER BY m.cls) AS logits
       FROM (SELECT v."index", f.label, v.v FROM
               (SELECT "index", list(mu ORDER BY pos) AS v FROM
                  (SELECT "index", pos, avg(x) AS mu FROM (SELECT "index", unnest(hs) AS x, generate_subscripts(hs, 1) AS pos FROM {CV} a) b
                    GROUP BY "index", pos) c GROUP BY "index") v
               JOIN (SELECT "index", arg_min(label, subix) FILTER (WHERE label IS NOT NULL) AS label FROM {CV} a GROUP BY "index") f
                 ON v."index" = f."index") d, {MEANS_SQL} m
      GROUP BY d."index", d.label) z)"""


def doc_predictions(spark, sf_dir):
    label = E.first_non_null("label", "subix").alias("label")
    d = E.pool_by_key(chunk_vectors(spark, sf_dir), "index", "hs", ("mean",), [label])
    return E.centroid_predictions(d, centroid_model(spark, sf_dir), "mean", "index", "label")


@register("m5_macro_metrics_documents", _macro_sql(DOC_PRED_SQL))
def q_m5_doc(spark, sf_dir):
    return _macro_out(M.macro_metrics(M.confusion(doc_predictions(spark, sf_dir))))


LSE_SQL = f"""(SELECT key, label, s, cls, max(s) OVER (PARTITION BY key) AS mx FROM {SCORES_SQL} a)"""
CE_SQL = f"""(SELECT key, label, ln(sum(exp(s - mx))) + max(mx) - max(CASE WHEN cls = label THEN s END) AS ce
    FROM {LSE_SQL} b GROUP BY key, label)"""


@register("m6_cross_entropy", f"SELECT round(avg(ce), 6) AS loss FROM {CE_SQL} q")
def q_m6(spark, sf_dir):
    return M.cross_entropy(predictions(spark, sf_dir)).select(rounded("loss", "loss"))


@register("m7_weighted_cross_entropy", f"""SELECT round(sum(w.w * q.ce) / sum(w.w), 6) AS loss FROM {CE_SQL} q
    JOIN (SELECT label, sum(count(*)) OVER () / count(*) AS w FROM {CV} a GROUP BY label) w ON q.label = w.label""")
def q_m7(spark, sf_dir):
    p = predictions(spark, sf_dir)
    w = L.class_weights(chunk_vectors(spark, sf_dir))
    return M.weighted_cross_entropy(p, w).select(rounded("loss", "loss"))


@register("m8_soft_f1_loss", f"""SELECT round(1 - avg(least(greatest(2 * p * r / (p + r + 1e-7), 1e-7), 1 - 1e-7)), 6) AS loss FROM
    (SELECT g.cls, coalesce(tp, 0) / (coalesce(tp, 0) + coalesce(fp, 0) + 1e-7) AS p, coalesce(tp, 0) / (coalesce(tp, 0) + coalesce(fn, 0) + 1e-7) AS r
       FROM (SELECT unnest(generate_series(0, 9)) AS cls) g LEFT JOIN
            (SELECT cls, sum(CASE WHEN cls = label THEN pr ELSE 0 END) AS tp, sum(CASE WHEN cls <> label THEN pr ELSE 0 END) AS fp,
                    sum(CASE WHEN cls = label THEN 1 - pr ELSE 0 END) AS fn
               FROM (SELECT key, label, cls, exp(s - mx) / sum(exp(s - mx)) OVER (PARTITION BY key) AS pr FROM {LSE_SQL} b) c GROUP BY cls) t
         ON g.cls = t.cls) z""")
def q_m8(spark, sf_dir):
    return M.soft_f1_loss(predictions(spark, sf_dir), 10).select(rounded("loss", "loss"))


def two_stage_tables(spark, sf_dir):
    p = predictions(spark, sf_dir)
    s1 = p.select("key", "label", "logits", (F.col("pred") > 0).cast("int").alias("pred"))
    selected = M.stage2_rows(p.select("key", "label", "logits"), s1, "key")
    s2 = selected.select("key", M.argmax(F.slice("logits", 2, F.size("logits") - 1)).alias("pred"))
    return s1, selected, s2


@register("m9_two_stage", f"""SELECT CAST(key AS BIGINT) AS key, CAST(label AS BIGINT) AS label,
      CAST(CASE WHEN pred > 0 THEN 1 ELSE 0 END AS BIGINT) AS stage1,
      CAST(CASE WHEN pred > 0 THEN list_position(logits[2:], list_max(logits[2:])) - 1 + 1 ELSE 0 END AS BIGINT) AS final
    FROM {PRED_SQL} p""")
def q_m9(spark, sf_dir):
    s1, _, s2 = two_stage_tables(spark, sf_dir)
    f = M.two_stage(s1, s2, "key")
    return f.select(F.col("key").cast("long"), F.col("label").cast("long"), F.col("pred").cast("long").alias("stage1"), F.col("final").cast("long"))


@register("m10_stage2_rows", f"SELECT CAST(key AS BIGINT) AS key, CAST(label AS BIGINT) AS label FROM {PRED_SQL} p WHERE pred > 0")
def q_m10(spark, sf_dir):
    _, sel, _ = two_stage_tables(spark, sf_dir)
    return sel.select(F.col("key").cast("long"), F.col("label").cast("long"))


@register("m9_two_stage_report", _report_out_sql(f"""(SELECT label, CASE WHEN pred > 0 THEN list_position(logits[2:], list_max(logits[2:])) ELSE 0 END AS pred
    FROM {PRED_SQL} p)"""))
def q_m9_report(spark, sf_dir):
    s1, _, s2 = two_stage_tables(spark, sf_dir)
    f = M.two_stage(s1, s2, "key").select("label", F.col("final").alias("pred"))
    return _report_out(M.classification_report(M.confusion(f)))


@register("u1_union_reports", f"""SELECT 'chunk' AS unit, * FROM ({_report_out_sql()}) a
    UNION ALL SELECT 'document' AS unit, * FROM ({_report_out_sql(DOC_PRED_SQL)}) b""")
def q_u1(spark, sf_dir):
    a = _report_out(M.classification_report(M.confusion(predictions(spark, sf_dir)))).withColumn("unit", F.lit("chunk"))
    b = _report_out(M.classification_report(M.confusion(doc_predictions(spark, sf_dir)))).withColumn("unit", F.lit("document"))
    return a.unionByName(b)


def _fold_pred_sql() -> str:
    v = f"""(SELECT c.doc_id, c.subix, c.label, c.cv, CAST(string_split(b.vec, ',') AS DOUBLE[]) AS hs
               FROM ({_chunks_sql(250)}) c JOIN {_bow_sql()} b ON b.doc_id = c.doc_id AND b.subix = c.subix)"""
    means = f"""(SELECT cls, list(mu ORDER BY pos) AS w FROM (SELECT label AS cls, pos, avg(x) AS mu FROM
                  (SELECT label, unnest(hs) AS x, generate_subscripts(hs, 1) AS pos FROM {v} t WHERE cv <> 0) u GROUP BY label, pos) m GROUP BY cls)"""
    scores = f"(SELECT e.doc_id, e.subix, e.label, m.cls, round(list_dot_product(e.hs, m.w), 8) AS s FROM {v} e, {means} m WHERE e.cv = 0)"
    return f"""(SELECT label, classes[list_position(logits, list_max(logits))] AS pred FROM
                 (SELECT doc_id, subix, label, list(s ORDER BY cls) AS logits, list(cls ORDER BY cls) AS classes FROM {scores} a GROUP BY doc_id, subix, label) b)"""


@register("m11_evaluate_fold", _report_out_sql(_fold_pred_sql()))
def q_m11(spark, sf_dir):
    """One fold end to end on real text: clean -> folds -> chunks -> hashed chunk features -> class
    centroids of the training folds -> score the validation fold -> per-class report."""
    from textprep.operators.folds import cv_split
    from textprep.plans.q_features import text_chunk_vectors

    v = text_chunk_vectors(spark, sf_dir)
    train, valid = cv_split(v, 0)
    model = E.collect_model(E.class_means(train, "hs", "label"))
    p = E.centroid_predictions(valid, model, "hs", "doc_id", "label")
    return _report_out(M.classification_report(M.confusion(p)))


# --- E8 / M11 over all folds -----------------------------------------------------------------------

def fold_rows(spark, sf_dir, folds: int = 5):
    """Mean-pooled documents ``(key, x, label, w, cv)``: class weights N / n_c (G1) and stratified folds (F1)."""
    from textprep.operators import labels as L
    from textprep.operators.folds import stratified_folds
    from textprep.sources.tables import chunk_vectors

    label = E.first_non_null("label", "subix").alias("label")
    d = E.pool_by_key(chunk_vectors(spark, sf_dir), "index", "hs", ("mean",), [label]).filter("label IS NOT NULL")
    d = d.select(F.col("index").alias("key"), F.col("mean").alias("x"), "label")
    cv = stratified_folds(d.select("key", "label"), "label", "key", k=folds).select("key", "cv")
    return L.sample_weights(d, "label").join(cv, "key")


@register("m11_all_folds")
def q_m11_folds(spark, sf_dir):
    """Five weighted heads, each fitted without its fold, in the same passes; every document is scored by the one that has not
    seen it."""
    from textprep.operators import fold_models as FM
    from textprep.session import checkpointed

    rows = checkpointed(fold_rows(spark, sf_dir))
    classes, weights, _ = FM.fit_folds(rows, 5)
    p = FM.score_held_out(rows, classes, weights)
    return p.select(F.col("key").cast("long"), F.col("cv").cast("long"), F.col("label").cast("long"), F.col("pred").cast("long"))
