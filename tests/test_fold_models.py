"""All folds in one fit against a plain solver that fits each fold alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textprep.operators import fold_models as FM
from textprep.plans import q_eval

SF = "/root/testdata/sf0.001"


def data(n=240, dim=5, classes=4, folds=3, seed=1):
    g = np.random.default_rng(seed)
    centre = g.normal(size=(classes, dim))
    y = g.integers(0, classes, n)
    x = centre[y] + g.normal(size=(n, dim))
    return x, y, g.uniform(0.2, 3, n), g.integers(0, folds, n)


def newton(x, y, w, classes, l2):
    """Plain weighted softmax regression: full Newton steps (least squares where intercepts are free)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    n, width = x.shape
    w = w / w.sum()
    theta = np.zeros((classes, width))
    ridge = np.full((classes, width), l2)
    ridge[:, -1] = 0
    for _ in range(100):
        z = x @ theta.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = ((p - np.eye(classes)[y]) * w[:, None]).T @ x + ridge * theta
        if np.abs(grad).max() < 1e-12:
            break
        hess = np.zeros((classes, width, classes, width))
        for a in range(classes):
            for b in range(classes):
                c = w * p[:, a] * ((a == b) - p[:, b])
                hess[a, :, b] = (x * c[:, None]).T @ x
        hess = hess.reshape(classes * width, -1) + np.diag(ridge.ravel())
        theta = theta - np.linalg.lstsq(hess, grad.ravel(), rcond=None)[0].reshape(classes, width)
    return theta


def centred(weights):
    weights = weights.copy()
    weights[..., -1] -= weights[..., -1].mean(axis=-1, keepdims=True)  # only differences of intercepts count
    return weights


def frame(spark, x, y, w, cv, names=lambda c: c):
    rows = [(i, v.tolist(), names(int(c)), float(m), int(f)) for i, (v, c, m, f) in enumerate(zip(x, y, w, cv))]
    return spark.createDataFrame(rows, "key long, x array<double>, label int, w double, cv int").repartition(5)


def test_coefficients_and_held_out_scores(spark):
    x, y, w, cv = data()
    df = frame(spark, x, y, w, cv, lambda c: 10 * c + 3)
    odd = spark.createDataFrame([(900, None, 3, 1.0, 0), (901, [0.0] * 5, None, 1.0, 1), (902, [0.0] * 5, 3, None, 1)], df.schema)
    classes, weights, passes = FM.fit_folds(df.unionByName(odd), 3, tol=1e-9)
    assert classes == [3, 13, 23, 33] and passes < 100
    for f in range(3):
        plain = newton(x[cv != f], y[cv != f], w[cv != f], 4, 0.01)
        np.testing.assert_allclose(centred(weights[f]), centred(plain), atol=1e-5)
    scored = {r["key"]: r for r in FM.score_held_out(df, classes, weights).collect()}
    assert len(scored) == len(x)
    for i in range(len(x)):
        z = np.append(x[i], 1) @ weights[cv[i]].T
        np.testing.assert_allclose(scored[i]["logits"], z, atol=1e-9)
        assert scored[i]["pred"] == classes[int(z.argmax())] and scored[i]["label"] == 10 * y[i] + 3
    right = np.mean([r["pred"] == r["label"] for r in scored.values()])
    assert right > 0.5  # of four classes


def test_a_fold_with_all_rows_and_no_rows(spark):
    x, y, w, cv = data(30)
    _, weights, _ = FM.fit_folds(frame(spark, x, y, w, np.zeros(30, int)), 2)
    assert not weights[0].any() and weights[1].any()  # model 0 has nothing to learn from
    with pytest.raises(ValueError, match="no rows"):
        FM.fit_folds(frame(spark, x, y, w, cv).limit(0), 2)


def test_limits(spark, monkeypatch):
    x, y, w, cv = data(30)
    df = frame(spark, x, y, w, cv)
    with pytest.raises(ValueError, match="length"):
        FM.fit_folds(df.withColumn("x", F.when(F.col("key") == 3, F.array(F.lit(1.0))).otherwise(F.col("x"))), 2)
    monkeypatch.setattr(FM, "MODEL_BYTES", 10)
    with pytest.raises(ValueError, match="bytes"):
        FM.fit_folds(df, 2)


def test_query_against_plain_solver(spark):
    """The registered query's held-out predictions on the small tables, fold by fold."""
    d = q_eval.fold_rows(spark, SF).collect()
    x, y, w, cv = np.array([r["x"] for r in d]), np.array([r["label"] for r in d]), np.array([r["w"] for r in d]), np.array([r["cv"] for r in d])
    classes = sorted(set(y.tolist()))
    place = np.array([classes.index(c) for c in y.tolist()])
    expected = {}
    for f in set(cv.tolist()):
        theta = newton(x[cv != f], place[cv != f], w[cv != f], len(classes), 0.01)
        for i in np.flatnonzero(cv == f):
            z = np.append(x[i], 1) @ theta.T
            expected[d[i]["key"]] = (classes[int(z.argmax())], np.sort(z)[-1] - np.sort(z)[-2])
    found = {r["key"]: r["pred"] for r in q_eval.q_m11_folds(spark, SF).collect()}
    assert found.keys() == expected.keys()
    assert all(found[k] == c for k, (c, margin) in expected.items() if margin > 1e-4)
