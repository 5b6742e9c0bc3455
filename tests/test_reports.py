import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.operators import reports


def test_t_quantile():
    for df, want in ((1, 12.7062), (5, 2.5706), (11, 2.2010), (30, 2.0423)):
        assert reports.t_quantile(0.975, df) == pytest.approx(want, abs=1e-3)
    assert reports.t_quantile(0.025, 5) == -reports.t_quantile(0.975, 5)


def test_weighted_trend_equals_normal_equations(spark):
    r = np.random.default_rng(4)
    x, c, w = r.random(80) * 9, r.integers(0, 6, 80), r.random(80) + 0.1
    y = 0.5 * x + c + r.random(80)
    rows = spark.createDataFrame([(int(a), float(b), float(d), float(e)) for a, b, d, e in zip(c, x, y, w, strict=True)], "c int, x double, y double, w double")
    got = reports.with_t_interval(reports.weighted_trend(rows, "c")).first()
    m = np.stack([np.ones(80), x], 1)
    inv = np.linalg.inv(m.T @ (m * w[:, None]))
    beta = inv @ (m.T @ (w * y))
    u = np.stack([(m * (w * (y - m @ beta))[:, None])[c == k].sum(0) for k in range(6)])
    cov = inv @ (u.T @ u) @ inv * 6 / 5 * 79 / 78
    assert (got.slope, got.intercept, got.se) == pytest.approx((beta[1], beta[0], np.sqrt(cov[1, 1])), abs=1e-7)
    assert got.low < got.slope < got.high and got.high - got.slope == pytest.approx(2.5706 * got.se, rel=1e-3)


def test_gold_labels(spark):
    readings = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, "a", "b"), (4, None, None)], "item int, first string, second string")
    log = spark.createDataFrame([(2, 1, "b"), (2, 5, "a"), (2, 3, "c"), (1, 1, "z")], "item int, position int, label string")
    assert {(r.item, r.label, r.source, r.scored) for r in reports.gold_labels(readings, log).collect()} == {(1, "a", "agreed", True), (2, "a", "adjudicated", True), (3, None, "open", False), (4, None, "open", False)}


def test_replay_leaves_incomplete_models_out(spark):
    a = spark.createDataFrame([("m", 1, True), ("m", 2, False), ("n", 1, True)], "model string, item int, flagged boolean")
    b = spark.createDataFrame([("m", 1, False), ("m", 2, False)], "model string, item int, flagged boolean")
    assert [tuple(r) for r in reports.replay_agreement(a, b).collect()] == [("m", 2, 1, 1, 0)]


def test_pareto(spark):
    rows = spark.createDataFrame([("x", 0.5, 1.0), ("y", 0.5, 2.0), ("z", 0.9, 3.0)], "name string, gain double, cost double").withColumn("g", F.lit(1))
    assert {r.name: r.dominated for r in reports.pareto(rows, ["g"], "name", "gain", "cost").collect()} == {"x": False, "y": True, "z": False}
