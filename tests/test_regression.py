"""Quantile lines of groups that are cut down, against the loss of every line through two points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacube.operators import regression, trends

PROBS = [0.05, 0.5, 0.9]


def least(x, y, q):
    """Smallest loss of a line through two points."""
    best = np.inf
    for i in range(len(x)):
        h = x - x[i]
        j = np.flatnonzero(h != 0)
        slopes = np.unique((y[j] - y[i]) / h[j])
        rest = (y - y[i])[None, :] - slopes[:, None] * h[None, :]
        best = min(best, np.where(rest >= 0, q * rest, (q - 1) * rest).sum(axis=1).min())
    return best


def groups():
    rng = np.random.default_rng(11)
    n = 240
    years = rng.integers(1950, 2023, n).astype(float)
    return {
        "years": (years, np.log10(rng.pareto(1.5, n) + 0.3) + (years - 1980) * 0.004),
        "ties": (rng.integers(0, 6, n).astype(float), rng.integers(0, 4, n).astype(float)),
        "steep": (rng.normal(size=n) * 1e-3, rng.normal(size=n) * 1e5 + 1e6),
        "outlier": (np.r_[rng.random(n - 1), 900.0], np.r_[rng.random(n - 1), -4000.0]),
        "line": (np.arange(n) / 7.0, 3.0 - np.arange(n) / 7.0),
        "one": (np.full(5, 2.0), np.arange(5.0)),
        None: (rng.random(12), rng.random(12)),
    }


def test_lines_have_the_least_loss(spark):
    data = groups()
    rows = [(k, float(a), float(b)) for k, (x, y) in data.items() for a, b in zip(x, y)] + [("years", None, 1.0), ("years", 1960.0, float("nan"))]
    table = spark.createDataFrame(rows, "k string, x double, y double").repartition(3)
    found = {(r["k"], r["quantile"]): r for r in regression.large_quantile_regression(table, "x", "y", ["k"], PROBS, most_points=20).collect()}
    assert set(found) == {(k, p) for k in data for p in PROBS}
    for k, (x, y) in data.items():
        for p in PROBS:
            r = found[k, p]
            if k == "one":
                assert r["slope"] is None and r["intercept"] is None
                continue
            rest = y - r["slope"] * x - r["intercept"]
            assert np.where(rest >= 0, p * rest, (p - 1) * rest).sum() <= least(x, y, p) * (1 + 1e-7) + 1e-6, (k, p)


def test_one_group_of_many_points(spark):
    n = 60_000
    table = spark.range(n).select((F.col("id") % 73 + 1950).cast("double").alias("x"), (F.rand(3) + (F.col("id") % 73) * 0.01).alias("y"))
    pdf = table.toPandas()
    fixed = spark.createDataFrame(pdf)
    got = {r["quantile"]: r for r in regression.large_quantile_regression(fixed, "x", "y", [], [0.1, 0.5], most_points=500).collect()}
    for q in (0.1, 0.5):
        slope, intercept = trends.quantile_line(pdf["x"].to_numpy(), pdf["y"].to_numpy(), q)
        loss = lambda s, i: float(np.where((r := pdf["y"] - s * pdf["x"] - i) >= 0, q * r, (q - 1) * r).sum())
        assert loss(got[q]["slope"], got[q]["intercept"]) == pytest.approx(loss(slope, intercept), rel=1e-9)
        assert got[q]["slope"] == pytest.approx(0.01, abs=2e-3)


def test_no_points(spark):
    none = spark.createDataFrame([], "k string, x double, y double")
    assert regression.large_quantile_regression(none, "x", "y", ["k"], PROBS).count() == 0
