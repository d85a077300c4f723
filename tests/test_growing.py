"""Stores that grow by years: each equals computing everything at once, and touches only what it must."""

import datetime
import math
import os
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacube.functions.columns import area_weight
from stratacube.operators import components, continued, states, stats, windows
from stratacube.operators.label_store import LabelStore
from stratacube.sources.years import stored_years


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def of_year(found, year):
    return {f: t for f, t in found.items() if f"year={year}" in f}


def voxels(spark, rows):
    return spark.createDataFrame([(x, y, t) for x, y, t in rows], "ilon int, ilat int, time date")


def date(text):
    return datetime.date.fromisoformat(text)


def test_labels_grow_as_if_labelled_at_once(spark, tmp_path):
    rng = random.Random(5)
    first = date("2000-12-01")
    days = [(x, y, first + datetime.timedelta(n)) for n in range(500) for x in range(4) for y in range(3) if rng.random() < (0.9 if n % 60 < 12 else 0.28)]
    table = voxels(spark, days)
    store = LabelStore(spark, f"file://{tmp_path}/store", 4, 3)
    again = [store.append(table.where(some)) for some in ("year(time) = 2000", "year(time) = 2001", "time < date'2002-02-10' and year(time) = 2002", "time >= date'2002-02-10'")]
    assert again[0] == [] and 2002 in again[3] and store.years() == [2000, 2001, 2002]
    want = {tuple(r) for r in components.label_components(table, 4, 3).select("ilon", "ilat", "time", "label").collect()}
    assert {tuple(r) for r in store.voxels(numbered=True).collect()} == want
    assert store.append(table.limit(0)) == []
    with pytest.raises(ValueError, match="cannot follow"):
        store.append(table.where("year(time) = 2001"))


def test_only_years_of_renamed_events_are_written_again(spark, tmp_path):
    def spell(x, y, a, b):
        return [(x, y, date(a) + datetime.timedelta(n)) for n in range((date(b) - date(a)).days + 1)]

    store = LabelStore(spark, f"file://{tmp_path}/store", 6, 3, wrap=False)
    store.append(voxels(spark, spell(0, 0, "2000-03-01", "2000-03-05") + spell(5, 2, "2000-02-01", "2000-02-03")))
    store.append(voxels(spark, spell(0, 0, "2001-11-01", "2001-12-31") + spell(2, 0, "2001-12-20", "2001-12-31")))
    before = files(tmp_path)
    # the two events of 2001 meet in 2002: the younger takes the older's name, 2000 stays as it is
    assert store.append(voxels(spark, [(x, 0, date("2002-01-01")) for x in range(3)])) == [2001]
    after = files(tmp_path)
    assert of_year(after, 2000) == of_year(before, 2000) and not of_year(after, 2001).items() & of_year(before, 2001).items()
    late = store.voxels().where("year(time) >= 2001")
    assert late.select("label").distinct().count() == 1
    # nothing touches: nothing earlier is written again
    assert store.append(voxels(spark, spell(5, 2, "2002-05-01", "2002-05-20") + [(0, 0, date("2003-01-01"))])) == [2002]
    assert of_year(files(tmp_path), 2001) == of_year(after, 2001)


def observations(spark, seed, years, n=40, shift=0.0):
    rng = np.random.default_rng(seed)
    rows = [(y, int(c), float(shift + rng.normal(c, 2)), float(rng.choice([-60.0, 0.0, 45.0, 80.0])), int(rng.integers(0, 5))) for y in years for c in range(3) for _ in range(n)]
    rows += [(years[0], 0, None, 0.0, 1), (years[0], 1, math.nan, 0.0, 2), (years[0], 2, 9e9, 90.0, 3), (years[0], 7, None, 10.0, 0)]
    return spark.createDataFrame(rows, "year int, cont int, v double, lat double, code int")


def kept_states(near):
    w = F.when(F.col("lat") < 90, area_weight(F.col("lat"))).otherwise(0.0)
    return {"m": states.moments(F.col("v"), w, near), "h": states.histogram(F.col("code"), w, 5), "e": states.extent(F.col("v"))}


@pytest.mark.parametrize(("at_once", "shift"), [(512, 0.0), (3, 1e8)])
def test_states_merge_to_the_one_pass_result(spark, tmp_path, monkeypatch, at_once, shift):
    monkeypatch.setattr(states, "AT_ONCE", at_once)
    all_rows = observations(spark, 1, list(range(1990, 2002)), shift=shift)
    path = f"file://{tmp_path}/states"
    for k, (low, high) in enumerate(((1990, 1992), (1993, 1998), (1999, 1999), (2000, 2001))):  # each part about a value of its own
        states.StateTable(spark, path, kept_states(shift + k * 5.0), ["cont"]).update(all_rows.where(F.col("year").between(low, high)))
    table = states.StateTable(spark, path, kept_states(0.0), ["cont"])
    got = {r["cont"]: r for r in table.merged(["cont"]).collect()}
    w = F.when(F.col("lat") < 90, area_weight(F.col("lat"))).otherwise(0.0)
    want = {r["cont"]: r for r in stats.weighted_variance(all_rows, "v", w, ["cont"]).collect()}
    assert set(got) == {0, 1, 2, 7} and set(want) == {0, 1, 2}
    for c, r in want.items():
        for name in ("n", "sum_w", "mean", "var_uncorrected", "var_analytic", "var_frequency"):
            assert got[c][f"m_{name}"] == pytest.approx(r[name], rel=1e-9 if shift == 0 else 1e-6), name
    assert got[7]["m_n"] == 0 and got[7]["m_mean"] is None and got[7]["m_var_uncorrected"] is None
    area = {(r["cont"], r["code"]): r["a"] for r in all_rows.groupBy("cont", "code").agg(F.sum(w).alias("a")).collect()}
    assert all(got[c]["h_area"][k] == pytest.approx(area.get((c, k), 0.0)) for c in got for k in range(5))
    one = table.merged([], [1995, 1996]).first()
    two = stats.weighted_variance(all_rows.where("year in (1995, 1996)").withColumn("g", F.lit(0)), "v", w, ["g"]).first()
    assert one["m_mean"] == pytest.approx(two["mean"]) and one["m_var_uncorrected"] == pytest.approx(two["var_uncorrected"], rel=1e-6)
    assert one["e_low"] <= one["m_mean"] <= one["e_high"]


def test_a_year_touches_only_its_own_states(spark, tmp_path):
    table = states.StateTable(spark, f"file://{tmp_path}/states", kept_states(0.0), ["cont"])
    table.update(observations(spark, 1, [1990, 1991]))
    before = files(tmp_path)
    table.update(observations(spark, 2, [1992]))
    table.update(observations(spark, 3, [1991]))
    after = files(tmp_path)
    assert table.years() == [1990, 1991, 1992] and of_year(before, 1990) == of_year(after, 1990)
    want = observations(spark, 1, [1990, 1991]).where("year = 1990").unionByName(observations(spark, 2, [1992])).unionByName(observations(spark, 3, [1991]))
    got = {r["cont"]: r["m_n"] for r in table.merged(["cont"]).collect()}
    w = F.when(F.col("lat") < 90, area_weight(F.col("lat"))).otherwise(0.0)
    assert {c: n for c, n in got.items() if n} == {r["cont"]: r["n"] for r in stats.weighted_variance(want, "v", w, ["cont"]).collect()}


def cells(spark, seed, n=500, odd=True):
    rng = random.Random(seed)
    start = date("1999-11-20")
    pick = lambda: rng.choice([None, math.nan]) if odd and rng.random() < 0.1 else float(rng.randint(0, 40))
    rows = [(c, 0, start + datetime.timedelta(t), pick()) for c in range(3) for t in range(n if c else n // 3)]
    return spark.createDataFrame(rows, "ilon int, ilat int, time date, v double").repartition(4)


PARTS = ("year(time) <= 1999", "year(time) = 2000 and month(time) < 4", "year(time) = 2000 and month(time) >= 4", "year(time) > 2000")


def same(rows):
    return sorted((r["ilon"], r["time"], *(None if x is None or math.isnan(x) else round(x, 9) for x in r[3:])) for r in rows)


def test_running_means_go_on_from_the_tail(spark, tmp_path):
    days = cells(spark, 4, odd=False)
    kept = continued.RunningMeans(spark, f"file://{tmp_path}/means", "v", {"a": 7, "b": 90})
    for some in PARTS:
        kept.append(days.where(some))
    want = windows.running_mean(windows.running_mean(days, F.col("v"), 7, "a"), F.col("v"), 90, "b")
    columns = ("ilon", "ilat", "time", "v", "a", "b")
    assert same(kept.days().select(*columns).collect()) == same(want.select(*columns).collect())
    assert kept.tail().groupBy("ilon").count().agg(F.max("count")).first()[0] == 89
    with pytest.raises(Exception, match="not later"):
        kept.append(days.where("time = date'2000-12-31'"))
    # the days themselves are not read: with their folder gone a new year still goes on
    shutil.move(f"{tmp_path}/means/days", f"{tmp_path}/away")
    more = spark.createDataFrame([(1, 0, date("2003-01-01"), 4.0)], days.schema)
    kept.append(more)
    assert stored_years(spark, f"file://{tmp_path}/means/days") == [2003]
    got = kept.days().first()
    old = sorted((r["time"], r["v"]) for r in days.where("ilon = 1").collect())
    assert got["a"] == pytest.approx((sum(v for _, v in old[-6:]) + 4.0) / 7) and got["b"] == pytest.approx((sum(v for _, v in old[-89:]) + 4.0) / 90)


def test_ranks_are_kept_up(spark, tmp_path):
    days = cells(spark, 6)
    kept = continued.Ranks(spark, f"file://{tmp_path}/ranks", "v")
    seen = None
    for some in PARTS:
        part = days.where(some)
        seen = part if seen is None else seen.unionByName(part)
        kept.append(part)
        want = windows.rank_transform(seen, F.col("v"), "r")
        columns = ("ilon", "ilat", "time", "r")
        assert same(kept.ranks("r").select(*columns).collect()) == same(want.select(*columns).collect())
    with pytest.raises(Exception, match="not later"):
        kept.append(days.where("time = date'2000-12-31'"))
