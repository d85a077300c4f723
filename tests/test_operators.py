"""Hand-made cases: edges of windows and runs, ties, missing values, components across the ring."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacube.functions.columns import erfc
from stratacube.operators import components, events, neighbours, quantiles, resample, stats, subset, trends, windows
from stratacube.operators.graph import connected_components
from stratacube.sources import readers, writers

D0 = datetime.date(2001, 1, 1)


def day(n):
    return D0 + datetime.timedelta(days=n)


def series(spark, values, name="v"):
    return spark.createDataFrame([(0, 0, day(i), v) for i, v in enumerate(values)], f"ilon int, ilat int, time date, {name} double")


def test_rank_ties_nan_and_null_last(spark):
    got = windows.rank_transform(series(spark, [3.0, 1.0, None, math.nan, 1.0]), F.col("v"), "r").orderBy("time").collect()
    assert [round(x.r * 5) for x in got] == [3, 1, 5, 4, 2]


def test_rank_is_a_permutation_and_threshold_share(spark):
    got = windows.rank_transform(series(spark, [float((i * 37) % 101) for i in range(100)]), F.col("v"), "r")
    assert sorted(round(x.r * 100) for x in got.collect()) == list(range(1, 101))
    assert got.where("r < 0.1").count() == math.ceil(0.1 * 100) - 1


def test_rolling_sum_edges(spark):
    got = windows.rolling_sum(series(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), F.col("v"), 1, 2, "s").orderBy("time").collect()
    assert [x.s for x in got] == [6, 10, 14, 18, 15, 11]
    with pytest.raises(ValueError):
        windows.rolling_sum(series(spark, [1.0]), F.col("v"), -1, 0, "s")


def test_running_mean_tapers_and_keeps_null(spark):
    got = windows.running_mean(series(spark, [2.0, 4.0, None, 6.0, 8.0]), F.col("v"), 2, "m").orderBy("time").collect()
    assert [x.m for x in got] == [2.0, 3.0, None, None, 7.0]


def test_rolling_all_first_row_looks_at_itself(spark):
    got = windows.rolling_all(series(spark, [1.0, 1.0, 0.0, 1.0]), F.col("v") > 0, -2, -1, "a").orderBy("time").collect()
    assert [x.a for x in got] == [True, True, True, False]


@pytest.mark.parametrize(("edge", "days"), [("strict", [7, 8, 9, 10]), ("replicate", [0, 1, 7, 8, 9, 10])])
def test_min_run_edges(spark, edge, days):
    flags = [1, 1, 0, 1, 1, 1, 0, 1, 1, 1, 1, 0]
    true = series(spark, [float(x) for x in flags]).where("v = 1")
    period = spark.createDataFrame([(day(0), day(11))], "first date, last date")
    got = windows.min_run_filter(true, period, 4, edge).orderBy("time").collect()
    assert [(x.time - D0).days for x in got] == days


def test_mode_without_zero_and_ties(spark):
    for values, want in (([0, 0, 0, 5, 7, 7], 7), ([0, 0], 0), ([4, 9, 9, 4], 4)):
        df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "g int, i int, v int")
        assert stats.mode_nonzero(df, "v", "i", ["g"]).first().mode == want
    assert stats.mode_nonzero(df.where("v > 100"), "v", "i", ["g"]).count() == 0


def test_theil_sen_both_intercepts(spark):
    df = spark.createDataFrame([(1, float(x), y) for x, y in ((1, 2.0), (2, 4.0), (3, 6.0), (4, 9.0))], "g int, x double, y double")
    a, b = trends.theil_sen(df, "x", "y", ["g"]).first(), trends.theil_sen(df, "x", "y", ["g"], "standard").first()
    assert a.slope == pytest.approx(13 / 6) and a.intercept == pytest.approx(0, abs=1e-9)
    assert b.intercept == pytest.approx(-0.25)


def test_mann_kendall_flat(spark):
    df = spark.createDataFrame([(1, float(x), 3.0) for x in range(5)], "g int, x double, y double")
    got = trends.mann_kendall(df, "x", "y", ["g"]).first()
    assert got.s == 0 and got.z == pytest.approx(-1 / math.sqrt(5 * 4 * 15 / 18)) and not got.reject and got.slope == 0


def test_quantile_regression_minimises_the_loss(spark):
    pts = [(1, float(i % 20), 2.0 * (i % 20) + (i * 7919 % 97) / 10) for i in range(400)]
    df = spark.createDataFrame(pts, "g int, x double, y double")
    for q in (0.1, 0.5, 0.9):
        fit = trends.quantile_regression(df, "x", "y", ["g"], [q]).first()
        loss = lambda s, i, q=q: sum((q if y >= s * x + i else q - 1) * (y - s * x - i) for _, x, y in pts)
        best = loss(fit.slope, fit.intercept)
        assert all(best <= loss(fit.slope + ds, fit.intercept + di) + 1e-9 * best for ds in (-0.02, 0, 0.02) for di in (-0.2, 0, 0.2))


def test_quantile_lines_against_all_lines_through_two_points():
    rng = random.Random(7)
    for k in range(60):
        n = rng.randint(3, 25)
        xs = np.array([float(rng.randint(0, 8) if k % 2 else rng.random()) for _ in range(n)])
        ys = np.array([float(rng.randint(0, 5) if k % 3 == 0 else rng.gauss(0, 1)) for _ in range(n)])
        if len(set(xs)) < 2:
            continue
        for q in (0.05, 0.5, 0.8):
            loss = lambda s, c, q=q: float(np.where((r := ys - s * xs - c) >= 0, q * r, (q - 1) * r).sum())
            best = min(loss(s, ys[i] - s * xs[i]) for i in range(n) for j in range(n) if xs[i] != xs[j] for s in [(ys[j] - ys[i]) / (xs[j] - xs[i])])
            assert loss(*trends.quantile_line(xs, ys, q)) <= best + 1e-9


def test_erfc_is_right_in_its_own_size(spark):
    xs = [0.0, 1e-9, 0.1, 0.5, 1.0, 2.0, 2.4999, 2.5, 3.0, 5.0, 8.0, 20.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", erfc(F.col("x")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(r.x), rel=1e-10)


def test_longitudes_and_boxes(spark):
    assert subset.lon_ranges(-10, -5) == [(350, 355)]
    assert subset.lon_ranges(-5, 15) == [(355, 360), (0, 15)]
    assert subset.lon_ranges(3, 9) == [(3, 9)]
    df = spark.createDataFrame([(12.3, 27.9), (-3.0, 15.0)], "a double, b double").select(subset.expand_low(F.col("a")).alias("a"), subset.expand_high(F.col("b")).alias("b"))
    assert [tuple(r) for r in df.collect()] == [(10, 30), (-5, 20)]


def boxes(spark):
    """Four boxes of a 20 x 10 x 30 cube; the second and third meet only through the ring."""
    spans = [((1, 7), (1, 2), (0, 9)), ((0, 1), (4, 7), (11, 19)), ((18, 19), (6, 8), (19, 22)), ((18, 19), (9, 9), (29, 29))]
    rows = [(x, y, day(t), k) for k, (xs, ys, ts) in enumerate(spans) for x in range(xs[0], xs[1] + 1) for y in range(ys[0], ys[1] + 1) for t in range(ts[0], ts[1] + 1)]
    return spark.createDataFrame(rows, "ilon int, ilat int, time date, k int")


def test_components_of_boxes(spark):
    days = boxes(spark)
    by = lambda df: {r.k: r.label for r in df.select("k", "label").distinct().collect()}
    assert by(components.label_components(days, 20, 10, wrap=False)) == {0: 1, 1: 2, 2: 3, 3: 4}
    assert by(components.label_components(days, 20, 10, wrap=True)) == {0: 1, 1: 2, 2: 2, 3: 3}
    tiled = components.label_by_tiles(days.withColumn("tile", F.floor(F.datediff("time", F.lit(D0)) / 7).cast("int")), "tile", 20, 10)
    assert by(tiled) == {0: 1, 1: 2, 2: 2, 3: 3}
    assert components.label_components(days.where("k > 9"), 20, 10).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "src long, dst long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[1001] == 1000


def test_diamond_and_opening(spark):
    assert sorted(neighbours.diamond(3)) == [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]
    cross = spark.createDataFrame([(2 + dx, 2 + dy, D0) for dx, dy in neighbours.diamond(3)] + [(0, 0, D0)], "ilon int, ilat int, time date")
    assert neighbours.opening(cross).count() == 5
    assert [(r.ilon, r.ilat) for r in neighbours.diamond_filter(cross, 5).collect()] == [(2, 2)]


def test_neighbourhoods_in_space_and_time(spark):
    assert len(neighbours.diamond(3, 3, 3)) == 7 and len(neighbours.diamond(3, 3, 5)) == 21 and len(neighbours.diamond(5)) == 13
    assert neighbours.box(3, 3)[:4] == [(-1, -1), (0, -1), (1, -1), (-1, 0)]
    with pytest.raises(ValueError):
        neighbours.box(2)
    cross = spark.createDataFrame([(2 + dx, 2 + dy, day(5 + dt)) for dx, dy, dt in neighbours.diamond(3, 3, 3)] + [(0, 0, day(5))], "ilon int, ilat int, time date")
    assert neighbours.opening(cross, (3, 3, 3)).count() == 7
    assert [(r.ilon, r.ilat, r.time) for r in neighbours.diamond_filter(cross, 7, (3, 3, 3)).collect()] == [(2, 2, day(5))]
    # a block in the corner of the grid at the start of the period stands when what lies outside does not count
    corner = spark.createDataFrame([(x, y, day(t)) for x in (0, 1) for y in (0, 1) for t in (0, 1)], "ilon int, ilat int, time date")
    period = spark.createDataFrame([(day(0), day(9))], "first date, last date")
    assert neighbours.opening(corner, (3, 3, 3)).count() == 0
    assert neighbours.opening_clipped(corner, (3, 3, 3), 5, period, None, 4).count() == 4
    runs = spark.createDataFrame([(x, 0, day(t)) for x, n in ((0, 4), (1, 2), (3, 5)) for t in range(n)], "ilon int, ilat int, time date")
    assert sorted((r.ilon, r.time) for r in neighbours.diamond_run_filter(runs, 2, 4, period).collect()) == [(0, day(0)), (0, day(1))]


def test_box_mode_takes_the_value_that_is_complete_first(spark):
    cube = spark.createDataFrame([(x, 0, day(t), v) for x, t, v in ((0, 0, 7), (1, 0, 7), (0, 1, 5), (1, 1, 5))], "ilon int, ilat int, time date, v int")
    got = {(r.ilon, r.time): (r.v, r["mode"]) for r in neighbours.box_mode(cube, "v", (3, 3, 3)).collect()}
    assert got[0, day(0)] == (7, 7) and got[1, day(1)] == (5, 7)
    masked = neighbours.box_mode(cube, "v", (3, 3, 3), mask=F.col("v") == 5)
    assert sorted(r["mode"] for r in masked.collect()) == [0, 0, 7, 7]


@pytest.mark.parametrize(("widths", "nlon"), [((3, 3, 5), 6), ((1, 3, 3), None), ((5, 1, 1), 6), ((3, 5, 1), None)])
def test_box_mode_against_a_plain_count(spark, widths, nlon):
    """Counted one axis after the other, with missing values, gaps and a ring: as a walk through every window; two exchanges."""
    rng = random.Random(sum(widths))
    cube = {(x, y, t): rng.choice((None, 0, 1, 1, 2)) for x in range(6) for y in range(4) for t in range(7) if rng.random() < 0.8}
    frame = spark.createDataFrame([(x, y, day(t), v) for (x, y, t), v in cube.items()], "ilon int, ilat int, time date, v int").repartition(3)
    found = neighbours.box_mode(frame, "v", widths, nlon)
    assert found._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 2
    want = {}
    for (x, y, t), own in cube.items():
        n, last = {}, {}
        for k, (dx, dy, dt) in enumerate(neighbours.box(*widths)):
            at = ((x + dx) % nlon if nlon else x + dx, y + dy, t + dt)
            if at in cube:
                n[cube[at]] = n.get(cube[at], 0) + 1
                last[cube[at]] = k
        want[x, y, day(t)] = (own, min(n, key=lambda v: (-n[v], last[v])))
    assert {(r.ilon, r.ilat, r.time): (r.v, r["mode"]) for r in found.collect()} == want
    assert neighbours.box_mode(frame.limit(0), "v", widths, nlon).count() == 0


def test_runs_of_years_meet_once(spark):
    long = [(0, 0, day(t), 0) for t in range(500)] + [(1, 0, day(t), 1) for t in range(100, 420)] + [(3, 0, day(t), 2) for t in range(3)]
    days = spark.createDataFrame(long, "ilon int, ilat int, time date, k int")
    _, edges = components.run_graph(days, 9, 9, False, "2001-01-01")
    assert edges.count() == 1
    assert {(r.k, r.label) for r in components.label_components(days, 9, 9, wrap=False).select("k", "label").distinct().collect()} == {(0, 1), (1, 1), (2, 2)}


def test_violations_fail_the_job(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(7)], "g int, i int, v double")
    assert resample.block_aggregate(df, F.max("v"), 3, "i", "v", ["g"], partial="drop").count() == 2
    with pytest.raises(Exception, match="no multiple of 3"):
        resample.block_aggregate(df, F.max("v"), 3, "i", "v", ["g"]).collect()
    areas = spark.createDataFrame([(1, 5.0, 1.0, 1.0, 1.0, 3.0)], "label int, heat double, drought30 double, drought90 double, drought180 double, compound double")
    assert stats.checked_types(areas, "label").count() == 1 and stats.checked_types(areas, "label").first().compound == 3.0
    with pytest.raises(Exception, match="compound exceeds its parts in event 1"):
        stats.checked_types(areas.withColumn("compound", F.lit(3.5)), "label").collect()


def test_reports_and_metadata(spark, tmp_path):
    table = spark.createDataFrame([("a_b", 1.234, 5), ("c", None, 6)], "name string, mean_value double, n int")
    writers.write_csv(table, f"file://{tmp_path}/out")
    assert sorted(spark.read.csv(f"file://{tmp_path}/out", header=True).collect()) == [("a_b", "1.234", "5"), ("c", None, "6")]
    assert writers.latex_table(table).split("\n") == [r"\begin{tabular}{rrr}", r"name & mean\_value & n \\ \hline", r"a\_b & 1.23 & 5 \\", r"c &  & 6 \\", r"\end{tabular}"]
    named = writers.with_metadata(writers.with_metadata(table, "n", units="1"), "n", long_name="number")
    assert named.schema["n"].metadata == {"units": "1", "long_name": "number"}


def test_stored_tables_follow_their_sources(spark, tmp_path):
    from stratacube.sources.workspace import stored

    path = f"file://{tmp_path}/source"
    spark.range(3).write.parquet(path)
    build = lambda: spark.read.parquet(path)
    assert stored(spark, "t", [build()], build).count() == 3 and stored(spark, "t", [build()], lambda: 1 / 0).count() == 3
    spark.range(5).write.mode("append").parquet(path)
    assert stored(spark, "t", [build()], build).count() == 8


def test_event_code_missing_and_bits(spark):
    df = spark.createDataFrame([(0.005, 0.5), (0.5, 0.5), (None, 0.005), (0.05, 0.95)], "a double, b double")
    got = [r.e for r in df.select(events.event_code([F.col("a"), F.col("b")], 0.01, 0.1).alias("e")).collect()]
    assert got == [1, 4, 2, 0]
    with pytest.raises(ValueError):
        events.event_code([], 0.1)


def test_weighted_variance_merges(spark):
    rows = [(i % 2, float(i), 1.0 + i % 3) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, x double, w double")
    for r in [*stats.weighted_variance(df, "x", F.col("w"), ["g"]).collect(), *stats.weighted_variance(df, "x", F.col("w"), ["g"], near=20).collect()]:
        part = [(x, w) for g, x, w in rows if g == r.g]
        sw = sum(w for _, w in part)
        mu = sum(x * w for x, w in part) / sw
        assert r["mean"] == pytest.approx(mu) and r.var_uncorrected == pytest.approx(sum(w * (x - mu) ** 2 for x, w in part) / sw)


def test_doy_quantiles_pool_around_the_year(spark):
    days = (datetime.date(2000, 1, 1) + datetime.timedelta(days=i) for i in range(731))
    df = spark.createDataFrame([(0, 0, d, float(i)) for i, d in enumerate(days)], "ilon int, ilat int, time date, v double")
    got = quantiles.day_of_year_quantiles(df, "v", [0.5])
    assert got.select("doy").distinct().count() == 366
    # the frames of both anchors of Mar-01, in the leap year and after it, hold 62 values
    assert got.where("doy = '03-01'").first().value == pytest.approx((60 + 425) / 2)


def test_interpolation_and_blocks(spark):
    nodes = spark.createDataFrame([(0, 10.0, 1.0), (0, 20.0, 3.0)], "g int, mid double, v double")
    ask = spark.createDataFrame([(0, datetime.date(1970, 1, 1) + datetime.timedelta(days=n)) for n in (5, 10, 15, 20, 25)], "g int, time date")
    got = [r.v for r in resample.interpolate_days(ask, nodes, "v", ["g"]).orderBy("time").collect()]
    assert got == [None, 1.0, 2.0, 3.0, None]


def test_store_append_replace_and_csv(spark, tmp_path):
    cube = series(spark, [float(i) for i in range(800)])
    path = f"{tmp_path}/cube"
    writers.write_cube(cube.where("year(time) = 2001"), path)
    writers.append_days(spark, cube, path)
    assert readers.read_cube(spark, path, columns=["time"]).count() == 800
    other = f"{tmp_path}/other"
    writers.write_cube(cube.where("v >= 790").withColumn("ilat", F.lit(3)), other)
    both = readers.read_cube(spark, path, other, columns=["ilat", "time", "v"])
    assert both.groupBy("ilat").count().orderBy("ilat").collect() == [(0, 800), (3, 10)]
    scan = both.where("v > 5 AND ilat = 3").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,5.0)" in scan and "ReadSchema: struct<ilat:int,v:double>" in scan
    writers.replace_years(cube.where("year(time) = 2002 AND v < 400"), path)
    assert spark.read.parquet(path).groupBy("year").count().where("year = 2002").first()["count"] == 35
    (tmp_path / "list.csv").write_text("some\nlines\nEvent,Start,North\nheat,2003.08.01,52.5\n")
    got = readers.read_event_list(spark, f"file://{tmp_path}/list.csv", "Event string, Start date, North double", preamble=2).collect()
    assert [(r.Event, str(r.Start), r.North) for r in got] == [("heat", "2003-08-01", 52.5)]
    names = spark.createDataFrame([("a/t2m.01.2020.parquet",), ("a/back_extension/t2m.01.2020.parquet",), ("a/x.txt",)], "path string")
    assert [(r.year, r.month, r.unique) for r in readers.one_file_per_month(names).collect()] == [(2020, 1, True)]


def test_tails_compile_and_trends_do_not_fall_back(spark):
    """With the fallback to interpretation switched off, code that cannot be compiled fails the job."""
    rows = [(c, y, float((y * 7 + c * 3) % 11)) for c in range(6) for y in range(1950, 2023)]
    table = spark.createDataFrame(rows, "cell int, year int, y double")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert trends.mann_kendall(table, "year", "y", ["cell"]).where("p_value BETWEEN 0 AND 1").count() == 6
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_interpolation_is_linear_in_the_length_of_a_series(spark):
    """Forty thousand days of one cell: frames that are built anew for each row would take minutes."""
    import time

    days = spark.range(40_000).select(F.lit(1).alias("cell"), F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("time"))
    start = F.datediff(F.lit("1900-01-01").cast("date"), F.lit("1970-01-01").cast("date"))
    nodes = spark.range(4_001).select(F.lit(1).alias("cell"), (F.col("id") * 10 + start).cast("double").alias("mid"), F.col("id").cast("double").alias("v"))
    began = time.time()
    got = resample.interpolate_days(days, nodes, "v", ["cell"]).withColumn("want", F.datediff("time", F.lit("1900-01-01").cast("date")) / 10.0)
    assert got.where("abs(v - want) < 1e-9").count() == 40_000 and time.time() - began < 20


def test_stored_table_is_built_again_when_it_has_gone(spark, tmp_path):
    from stratacube.sources import workspace

    spark.range(5).write.parquet(f"file://{tmp_path}/source")
    source, built = spark.read.parquet(f"file://{tmp_path}/source"), []

    def build():
        built.append(1)
        return source.withColumn("n", F.lit(len(built)))

    assert workspace.stored(spark, "twice", [source], build).count() == 5 and workspace.stored(spark, "twice", [source], build).first()["n"] == 1
    place = next(v for k, v in workspace._stored.items() if k[1] == "twice")
    fs, path = workspace.place(spark, place)
    fs.delete(path, True)
    assert workspace.stored(spark, "twice", [source], build).first()["n"] == 2 and len(built) == 2


def test_hexagons_are_the_nearest_centres(spark):
    rng = np.random.default_rng(3)
    dx, dy = 2.0, 0.5
    pts = np.c_[rng.uniform(-9, 9, 400), rng.uniform(-3, 3, 400)]
    pts[:4] = [(0, 0), (1.0, 0.375), (-1.0, -0.375), (2.0, 0.0)]  # centres of both lattices
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "x double, y double")
    rows = df.select("x", "y", stats.hexagon(F.col("x"), F.col("y"), dx, dy).alias("h")).select("x", "y", "h.*").collect()
    centres = [(i * dx, j * 1.5 * dy) for i in range(-8, 9) for j in range(-8, 9)] + [((i + 0.5) * dx, (j * 1.5 + 0.75) * dy) for i in range(-8, 9) for j in range(-8, 9)]
    for r in rows:
        away = [((r.x - a) / dx) ** 2 + ((r.y - b) / dy) ** 2 * 4 / 3 for a, b in centres]
        assert ((r.x - r.cx) / dx) ** 2 + ((r.y - r.cy) / dy) ** 2 * 4 / 3 == pytest.approx(min(away), abs=1e-12)
        assert min(abs(a - r.cx) + abs(b - r.cy) for a, b in centres) < 1e-9
    odd = df.union(spark.createDataFrame([(None, 1.0), (1.0, math.nan)], df.schema))
    assert stats.histogram_hexagons(odd, F.col("x"), F.col("y"), dx, dy).agg(F.sum("n")).first()[0] == 400


def test_pairs_of_a_long_series_are_refused(spark, monkeypatch):
    monkeypatch.setattr(trends, "LONGEST", 10)
    table = spark.createDataFrame([(1, y, float(y)) for y in range(10)] + [(2, y, float(y)) for y in range(11)], "cell int, year int, y double")
    assert trends.theil_sen(table.where("cell = 1"), "year", "y", ["cell"]).count() == 1
    with pytest.raises(Exception, match="more than 10 points"):
        trends.mann_kendall(table, "year", "y", ["cell"]).collect()


def test_nearest_cells_against_every_pair_without_a_broadcast_of_points(spark):
    cells = spark.range(400).selectExpr("cast(id % 20 AS int) AS ilon", "cast(floor(id / 20) AS int) AS ilat", "(id % 20) * 2.5 - 10 AS lon", "floor(id / 20) * 1.25 AS lat")
    points = spark.range(300).selectExpr("if(id < 4, 0, id) AS name", "if(id = 9, null, id * 7 % 90 - 20.25) AS plon", "(id * 11 % 60) - 15.5 AS plat")
    found = subset.nearest_cell(cells, points, 6.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Generate explode") == 2  # points are neither sent whole nor multiplied
    best, grid = {}, cells.collect()
    for name, plon, plat in points.collect():
        for i, j, lon, lat in grid if plon is not None else ():
            if abs(lon - plon) <= 6 and abs(lat - plat) <= 6:
                one = ((lon - plon) ** 2 + (lat - plat) ** 2, i, j, plon, plat, lon, lat)
                best[name] = min(best.get(name, one), one)
    assert 0 in best and len(best) < 290
    got = {r["name"]: (r.ilon, r.ilat, r.plon, r.plat, r.lon, r.lat) for r in found.collect()}
    assert found.columns == ["name", "plon", "plat", "ilon", "ilat", "lon", "lat"] and got == {k: v[1:] for k, v in best.items()}
