"""Preference and taste operators against numpy."""

import numpy as np
from pyspark.sql import functions as F

from cinegrain.operators import preference, taste


def test_fold_equals_a_loop(spark):
    g = np.random.default_rng(1)
    rows = [(m, i, g.normal(size=3).tolist(), g.normal(size=3).tolist()) for m in ("a", "b") for i in range(5)]
    got = {r.m: r for r in preference.fold(spark.createDataFrame(rows[::-1], "m string, i int, w array<double>, l array<double>"), "m", "i", "w", "l").collect()}
    mean, var = np.zeros(3), np.full(3, 4.0)
    for _, _, w, l in rows[:5]:
        d = np.array(w) - np.array(l)
        p = 1 / (1 + np.exp(-(mean @ d)))
        var = 1 / (1 / var + p * (1 - p) * d * d)
        mean = mean + var * (1 - p) * d
        mean /= np.linalg.norm(mean)
    assert got["a"].n == 5 and np.allclose(got["a"].mean, mean, atol=1e-5) and np.allclose(got["a"].variance, var, atol=1e-5)


def test_warm_start_and_scores(spark):
    x, y = np.random.default_rng(2).normal(size=(20, 4)), np.arange(20.0)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(20)], "k long, v array<double>, s double")
    b = x.T @ ((y - y.mean()) / y.std()) / ((x * x).sum(0) + 1)
    model = preference.warm_start(df, "v", F.col("s"))
    got = [r["mean"] for r in model.orderBy("pos").collect()]
    assert np.allclose(got, b / np.linalg.norm(b), atol=1e-5)
    s = {r.k: (r.score, r.sigma) for r in preference.scores(df, "k", "v", model.withColumn("variance", F.lit(4.0))).collect()}
    assert np.isclose(s[3][1], 2 * np.linalg.norm(x[3]), atol=1e-5) and np.isclose(s[3][0], x[3] @ got, atol=1e-5)


def test_blend_and_shares(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 1.0]), (2, [1.0, 0.0], None), (3, None, [0.0, 2.0]), (4, [1.0, 0.0], [1.0])], "k long, a array<float>, b array<float>")
    got = {r.k: r.v for r in df.select("k", taste.blended(F.col("a"), F.col("b"), 0.5).alias("v")).collect()}
    assert np.allclose(got[1], [0.5**0.5] * 2) and got[2] == [1.0, 0.0] and got[3] == [0.0, 2.0] and got[4] == [1.0, 0.0]
    s = spark.createDataFrame([(0, 3.0), (0, 1.0), (1, 0.0)], "c int, s double")
    assert {r.c: r.share for r in taste.shares(s, "c", "s").collect()} == {0: 1.0, 1: 0.0}
