"""Logistic regression against a numpy Newton solve of sklearn's objective,
and AUC against brute-force pair counting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mercata.operators import scorecard as s


def _newton_logistic(X, y, C):
    """argmin 1/2 ||w||^2 + C * sum(logloss), free intercept."""
    n, k = X.shape
    A = np.hstack([X, np.ones((n, 1))])
    beta = np.zeros(k + 1)
    reg = np.eye(k + 1)
    reg[-1, -1] = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-A @ beta))
        grad = reg @ beta + C * A.T @ (p - y)
        hess = reg + C * (A.T * (p * (1 - p))) @ A
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-12:
            break
    return beta[:k], beta[k]


def test_logistic_matches_sklearn_objective(spark):
    rng = np.random.default_rng(0)
    n = 4000
    X = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * X[:, 0] - 0.5 * X[:, 1] - 1.0)))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(X, y)], "x1 double, x2 double, target int")
    model = s.fit_logistic(df, ["x1", "x2"], "target", C=1.0)
    coefs = {r.feature: r.coef for r in s.coefficients(model, ["x1", "x2"], spark).collect()}
    w, b = _newton_logistic(X, y, 1.0)
    assert coefs["x1"] == pytest.approx(w[0], abs=1e-5)
    assert coefs["x2"] == pytest.approx(w[1], abs=1e-5)
    assert coefs["(intercept)"] == pytest.approx(b, abs=1e-5)


def test_auc_matches_pair_counting(spark):
    rng = np.random.default_rng(1)
    score = np.round(rng.random(600), 2)  # many ties
    label = (rng.random(600) < score).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(score, label)], "score double, target int")
    pos, neg = score[label == 1], score[label == 0]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert s.auc(df).collect()[0].auc == pytest.approx(brute, rel=1e-12)
    # KS = max over thresholds of TPR - FPR
    ths = np.unique(score)
    ks = max(((pos >= t).mean() - (neg >= t).mean()) for t in ths)
    assert s.ks(s.roc_curve(df)).collect()[0].ks == pytest.approx(ks, rel=1e-12)


def test_split_is_stratified_and_deterministic(spark):
    df = spark.range(20000).select(F.col("id").alias("k"), (F.col("id") % 7 == 0).cast("int").alias("target"))
    a = s.stratified_split(df, ["k"], "target", test=0.3, seed=42)
    b = s.stratified_split(df, ["k"], "target", test=0.3, seed=42)
    assert a.exceptAll(b).count() == 0
    shares = {r.target: r.share for r in a.groupBy("target").agg(
        F.avg((F.col("split") == "test").cast("double")).alias("share")).collect()}
    assert all(abs(v - 0.3) < 0.03 for v in shares.values())
    exact = s.stratified_split(df, ["k"], "target", test=0.3, seed=42, exact=True)
    counts = {(r.target, r.split): r["count"] for r in exact.groupBy("target", "split").count().collect()}
    n1, n0 = 20000 // 7 + 1, 20000 - (20000 // 7 + 1)
    assert counts[(1, "test")] == -(-3 * n1 // 10) and counts[(0, "test")] == -(-3 * n0 // 10)
