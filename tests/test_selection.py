"""Quantiles by rank against numpy, with ranges small enough that they must be narrowed many times."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacube.operators import selection

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def groups():
    rng = np.random.default_rng(7)
    return {
        "even": rng.normal(size=4000), "ties": np.repeat([3.0, 1.0, 2.0], [2500, 10, 900]), "one": np.array([5.0]), "two": np.array([1.0, 2.0]), "outliers": np.r_[rng.random(3000), 1e300, -1e300, 1e-300],
        "powers": np.array([float(2.0**k) for k in range(-1000, 1000, 4)]), "tiny": np.array([5e-324 * k for k in range(1, 200)]), "same": np.full(500, -7.25), "extreme": np.array([-math.inf, -1.7e308, 0.0, 1.7e308, math.inf] * 40), None: rng.integers(0, 50, 700) / 7,
    }


@pytest.mark.parametrize("rows", [30, 1 << 20])
def test_quantiles_of_any_group(spark, rows):
    data = groups()
    odd = [("even", None), ("even", math.nan), ("nothing", None), ("nothing", math.nan)]
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v] + odd, "k string, x double").repartition(5)
    got = {(r["k"], r["quantile"]): r["value"] for r in selection.exact_quantiles(df, F.col("x"), PROBS, ["k"], rows).collect()}
    assert set(got) == {(k, p) for k in data for p in PROBS}
    for k, v in data.items():
        s = np.sort(v)
        for p in PROBS:
            at = p * (len(s) - 1)
            a, b = math.floor(at), math.ceil(at)
            want = s[a] if a == b else (b - at) * s[a] + (at - a) * s[b]
            assert got[k, p] == want or abs(got[k, p] - want) <= 1e-12 * abs(want) or (math.isnan(want) and math.isnan(got[k, p])), (k, p)


def test_no_keys_several_keys_and_no_rows(spark):
    df = spark.range(1001).select((F.col("id") % 7).alias("a"), (F.col("id") % 2 == 0).alias("b"), F.col("id").cast("double").alias("x"))
    assert [(r["quantile"], r["value"]) for r in selection.exact_quantiles(df, F.col("x"), [0.5], [], 10).collect()] == [(0.5, 500.0)]
    two = {(r["a"], r["b"]): r["median"] for r in selection.exact_five_numbers(df, F.col("x"), ["a", "b"], 10).collect()}
    want = {(a, b): float(np.median([i for i in range(1001) if i % 7 == a and (i % 2 == 0) == b])) for a in range(7) for b in (True, False)}
    assert two == want
    assert selection.exact_quantiles(df.limit(0), F.col("x"), [0.5], ["a"]).count() == 0
