"""User functions over cubes: axes, several cubes, one shuffle, checks."""

import numpy as np
import pytest

from stratacube.operators.kernels import Input, Output, map_cubes


def cube(spark):
    rows = [(x, y, t, k, float(100 * x + 10 * y + t) if (x + t) % 5 else None) for x in range(3) for y in range(2) for t in range(6) for k in ("a", "b")]
    return spark.createDataFrame(rows, "ilon int, ilat int, t int, kind string, v double").repartition(4)


def test_two_input_axes_and_a_static_cube_in_one_shuffle(spark):
    mask = spark.createDataFrame([(x, y, 2.0 + x) for x in range(2) for y in range(2)] + [(9, 9, 1.0)], "ilon int, ilat int, f double")

    def kernel(days, cell):
        assert days.grid("v").shape == (2, 6) and list(days.axes) == ["kind", "t"]
        return {"t": np.arange(6), "s": np.nansum(days.grid("v"), axis=0) * (cell["f"][0] if len(cell) else np.nan)}

    got = map_cubes(kernel, [Input(cube(spark), ("kind", "t"), ("v",)), Input(mask, (), ("f",))], Output({"t": "integer"}, {"s": "double"}, {"t": range(6)}))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(ilon") == 1
    rows = {(r["ilon"], r["ilat"], r["t"]): r["s"] for r in got.collect()}
    assert len(rows) == 36
    assert rows[1, 1, 2] == 2 * 112.0 * 3.0 and rows[0, 0, 0] == 0.0 and rows[2, 0, 1] is None


@pytest.mark.parametrize(
    ("result", "message"),
    [({"s": [1.0]}, "returned"), ({"t": [1, 2], "s": [1.0]}, "do not fit"), ({"t": [1, 1], "s": [1.0, 2.0]}, "two values"), ({"t": [7], "s": [1.0]}, "not as declared")],
)
def test_results_that_do_not_fit_fail(spark, result, message):
    got = map_cubes(lambda days: result, [Input(cube(spark), ("kind", "t"), ("v",))], Output({"t": "integer"}, {"s": "double"}, {"t": [1, 2]}))
    with pytest.raises(Exception, match=message):
        got.collect()


def test_scalars_repeated_places_and_empty_cubes(spark):
    one = map_cubes(lambda days: {"n": len(days)}, [Input(cube(spark), ("kind", "t"), ("v",))], Output({}, {"n": "long"}))
    assert sorted(r["n"] for r in one.collect()) == [12] * 6
    with pytest.raises(Exception, match="two rows"):
        map_cubes(lambda days: {"n": len(days)}, [Input(cube(spark), ("t",), ("v",))], Output({}, {"n": "long"})).collect()
    assert map_cubes(lambda days: {"n": 0}, [Input(cube(spark).limit(0), ("t",), ("v",))], Output({}, {"n": "long"})).count() == 0
