"""Layers in one layout: joined and put through windows without an exchange, with the rows of a plain join."""

import random

import pytest
from pyspark.sql import functions as F

from stratacube.jobs import stat_queries
from stratacube.operators.windows import rank_transform, running_mean
from stratacube.sources.layout import CubeLayout


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange")


@pytest.fixture
def cube(spark):
    made = CubeLayout(spark, 6)
    yield made
    made.drop()


def layer(spark, name, seed, n=60):
    rng = random.Random(seed)
    rows = [(x, y, t, rng.random()) for x in range(4) for y in range(3) for t in range(n) if rng.random() < 0.9]
    return spark.createDataFrame(rows, f"ilon int, ilat int, time int, {name} double").repartition(3)


def test_twelve_layers_and_a_mask_without_exchange(spark, cube):
    parts = [layer(spark, f"v{k}", k) for k in range(12)]
    for k, part in enumerate(parts):
        cube.add(f"l{k}", part)
    mask = spark.createDataFrame([(x, y, (x + y) % 2) for x in range(4) for y in range(3)], "ilon int, ilat int, land int")
    cube.add("mask", mask)
    got = cube.joined()
    assert exchanges(got) == 0
    plain = parts[0]
    for part in parts[1:]:
        plain = plain.join(part, ["ilon", "ilat", "time"])
    plain = plain.join(mask, ["ilon", "ilat"])
    columns = sorted(plain.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, plain.select(*columns).collect())) and got.count() > 100
    # one exchange only: the partial sums of the aggregate
    assert exchanges(got.groupBy("land").agg(F.sum("v3"))) == 1


def test_windows_stay_in_the_layout(spark, cube):
    stored = cube.add("v", layer(spark, "v", 3))
    more = rank_transform(running_mean(stored, F.col("v"), 7, "m"), F.col("m"), "r")
    assert exchanges(more) == 0
    again = cube.add("w", more.select("ilon", "ilat", "time", "m", "r"), dealt=True)
    assert exchanges(rank_transform(again, F.col("r"), "q")) == 0 and exchanges(cube.joined()) == 0
    want = rank_transform(running_mean(layer(spark, "v", 3), F.col("v"), 7, "m"), F.col("m"), "r")
    pick = ("ilon", "ilat", "time", "v", "m", "r")
    assert sorted(map(tuple, cube.joined().select(*pick).collect())) == sorted(map(tuple, want.select(*pick).collect()))


def test_the_query_joins_its_fifteen_layers_without_exchange(spark, data):
    assert exchanges(stat_queries.cube_layout(spark, data, 4).joined()) == 0
