"""Queries on hourly and daily series: windows, resampling, indicators, quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacube.jobs.declare import registrar
from stratacube.jobs.sql import CELL, ENSEMBLE, GRID, HOURLY, MASK, PEI, RANKS, r
from stratacube.operators import continued, kernels, quantiles, resample, selection, windows
from stratacube.operators.indicators import reference_evapotranspiration, water_balance
from stratacube.sources import views
from stratacube.sources.workspace import Workspace

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)


@query(f"WITH {RANKS} SELECT ilon, ilat, time, {r('rt')} AS rt, {r('rd30')} AS rd30 FROM ranks")
def rank_transform(spark, d):
    return views.grid_ranks(spark, d).select("ilon", "ilat", "time", "rt", "rd30")


@query(f"WITH {PEI} SELECT ilon, ilat, time, {r('wb')} AS wb, {r('pei_30')} AS pei_30, {r('pei_90')} AS pei_90, {r('pei_180')} AS pei_180 FROM pei")
def running_mean_30_90_180(spark, d):
    return views.grid_ranks(spark, d).select("ilon", "ilat", "time", "wb", "pei_30", "pei_90", "pei_180")


@query(f"WITH {PEI} SELECT ilon, ilat, time, {r('pei_30')} AS pei_30, {r('pei_90')} AS pei_90, {r('pei_180')} AS pei_180 FROM pei")
def running_mean_append(spark, d):
    """The moving balances of all days, computed to 1996 and continued by the later years from each cell's last rows."""
    ws = Workspace(spark, "running_mean_append")
    days = ws.save(views.grid_daily(spark, d).select("ilon", "ilat", "time", water_balance(F.col("tp"), F.col("pet")).alias("wb")), "days")
    kept = continued.RunningMeans(spark, f"{ws.path}/store", "wb", {f"pei_{n}": n for n in (30, 90, 180)})
    for some in ("year(time) <= 1996", "year(time) = 1997", "year(time) >= 1998"):
        kept.append(days.where(some))
    return kept.days().select("ilon", "ilat", "time", "pei_30", "pei_90", "pei_180")


@query(f"WITH {RANKS} SELECT ilon, ilat, time, {r('rt')} AS rt FROM ranks")
def rank_append(spark, d):
    """Heat ranks over all days, kept up as the years after 1996 are added."""
    ws = Workspace(spark, "rank_append")
    days = ws.save(views.grid_daily(spark, d).select("ilon", "ilat", "time", (F.round("t2mmax", 9) * -1.0).alias("v")), "days")
    kept = continued.Ranks(spark, f"{ws.path}/store", "v")
    for some in ("year(time) <= 1996", "year(time) = 1997", "year(time) >= 1998"):
        kept.append(days.where(some))
    return kept.ranks("rt").select("ilon", "ilat", "time", "rt")


def _rank_on_land(days, cell):
    """Heat rank of every day of a cell that is mostly land; none elsewhere."""
    import numpy as np

    order = np.argsort(-days["heat"], kind="stable")
    rank = np.empty(len(days))
    rank[order] = np.arange(1, len(days) + 1) / len(days)
    return {"time": days["time"], "rt": rank if cell["lsm"][0] > 0.5 else np.full(len(days), np.nan)}


@query(f"WITH {RANKS}, {MASK} SELECT ilon, ilat, time, {r('CASE WHEN lsm > 0.5 THEN rt END')} AS rt FROM ranks JOIN mask USING (ilon, ilat)")
def kernel_rank(spark, d):
    """The heat rank as a user's function over two cubes, days and cells."""
    days = kernels.Input(views.grid_daily(spark, d).select("ilon", "ilat", "time", F.round("t2mmax", 9).alias("heat")), ("time",), ("heat",))
    cell = kernels.Input(views.mask(spark, d), (), ("lsm",))
    return kernels.map_cubes(_rank_on_land, [days, cell], kernels.Output({"time": "date"}, {"rt": "double"}))


@query(f"WITH {HOURLY} SELECT ilon, ilat, ts, {r('SUM(tp) OVER (PARTITION BY ilon, ilat ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)')} AS rs FROM hourly")
def rolling_sum_centered(spark, d):
    return windows.rolling_sum(views.hourly(spark, d), F.col("tp"), 12, 11, "rs", "ts").select("ilon", "ilat", "ts", "rs")


@query(f"""WITH {GRID} SELECT ilon, ilat, time, COALESCE(MIN(CASE WHEN n_obs < 3 THEN 1 ELSE 0 END) OVER ({CELL} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
    CASE WHEN n_obs < 3 THEN 1 ELSE 0 END) = 1 AS low FROM grid""")
def rolling_all(spark, d):
    return windows.rolling_all(views.grid_daily(spark, d), F.col("n_obs") < 3, -5, -1, "low").select("ilon", "ilat", "time", "low")


@query(f"""WITH {HOURLY} SELECT ilon, ilat, CAST(ts AS DATE) AS time, {r('AVG(t2m)')} AS t2m, {r('MAX(t2m)')} AS t2mmax, {r('MIN(t2m)')} AS t2mmin, {r('SUM(tp)')} AS tp
    FROM hourly GROUP BY ilon, ilat, CAST(ts AS DATE)""")
def daily_agg(spark, d):
    aggs = {"t2m": F.avg("t2m"), "t2mmax": F.max("t2m"), "t2mmin": F.min("t2m"), "tp": F.sum("tp")}
    return resample.daily_aggregate(views.hourly(spark, d), aggs)


@query(f"""WITH {HOURLY} SELECT ilon, ilat, CAST(ts AS DATE) AS time, COUNT(tp) AS n_steps, CASE WHEN COUNT(tp) = 24 THEN {r('SUM(tp)')} END AS tp
    FROM hourly GROUP BY ilon, ilat, CAST(ts AS DATE)""")
def daily_complete(spark, d):
    return resample.complete_daily_sum(views.hourly(spark, d), "tp")


@query(f"""WITH {HOURLY}, b AS (SELECT ilon, ilat, CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY ilon, ilat ORDER BY ts) - 1) / 24) AS BIGINT) AS block, tp FROM hourly)
    SELECT ilon, ilat, block, {r('MAX(tp)')} AS tp FROM b GROUP BY ilon, ilat, block HAVING COUNT(*) = 24""")
def block_max(spark, d):
    return resample.block_aggregate(views.hourly(spark, d), F.max("tp"), 24, "ts", "tp", ["ilon", "ilat"], partial="drop")


@query(f"WITH {GRID} SELECT CAST(FLOOR(ilon / 3) AS BIGINT) AS ilon, CAST(FLOOR(ilat / 3) AS BIGINT) AS ilat, time, {r('AVG(t2m)')} AS t2m FROM grid GROUP BY 1, 2, 3")
def coarsen(spark, d):
    return resample.coarsen(views.grid_daily(spark, d), "t2m", 3, ["time"])


_ENS = "COUNT(CASE WHEN v > 0 AND v < 40 THEN v END)"


@query(f"""WITH {ENSEMBLE} SELECT ilon, ilat, time, {_ENS} AS n_good, CASE WHEN {_ENS} > 5 THEN {r('AVG(CASE WHEN v > 0 AND v < 40 THEN v END)')} END AS v
    FROM ensemble GROUP BY ilon, ilat, time""")
def ensemble_mean(spark, d):
    return resample.ensemble_mean(views.ensemble(spark, d), "v", ["ilon", "ilat", "time"])


_DAY = "CAST({} - DATE '1970-01-01' AS DOUBLE)"


@query(f"""WITH {GRID}, node AS (SELECT ilon, ilat, MIN(time) AS start_, AVG(t2m) AS v FROM grid GROUP BY ilon, ilat, CAST(FLOOR((time - DATE '1970-01-01') / 8) AS BIGINT)),
    mid AS (SELECT ilon, ilat, {_DAY.format('start_')} + CAST(COALESCE(LEAD(start_) OVER (PARTITION BY ilon, ilat ORDER BY start_), MAKE_DATE(YEAR(start_) + 1, 1, 1)) - start_ AS DOUBLE) / 2 AS mid, v FROM node),
    seg AS (SELECT ilon, ilat, mid AS x0, v AS y0, LEAD(mid) OVER w AS x1, LEAD(v) OVER w AS y1 FROM mid WINDOW w AS (PARTITION BY ilon, ilat ORDER BY mid)),
    ask AS (SELECT ilon, ilat, time, {_DAY.format('time')} AS at FROM grid)
    SELECT a.ilon, a.ilat, a.time, {r('CASE WHEN s.x1 IS NULL THEN CASE WHEN a.at = s.x0 THEN s.y0 END ELSE s.y0 + (s.y1 - s.y0) * (a.at - s.x0) / (s.x1 - s.x0) END')} AS v
    FROM ask a ASOF LEFT JOIN seg s ON a.ilon = s.ilon AND a.ilat = s.ilat AND a.at >= s.x0""")
def time_interp(spark, d):
    grid = views.grid_daily(spark, d)
    key = F.floor(F.datediff("time", F.lit("1970-01-01").cast("date")) / 8)
    nodes = grid.groupBy("ilon", "ilat", key.alias("k")).agg(F.min("time").alias("time"), F.avg("t2m").alias("v"))
    mids = resample.mid_period(nodes, F.make_date(F.year("time") + 1, F.lit(1), F.lit(1)), by=["ilon", "ilat"])
    return resample.interpolate_days(grid.select("ilon", "ilat", "time"), mids, "v", ["ilon", "ilat"])


_PETV = """h AS (SELECT event_id, 283.15 + value / 20 AS t, (user_id % 7) / 2.0 AS u, (user_id % 5) / 3.0 AS v, 100000.0 - value * 5 AS sp, (HOUR(ts) - 8) * 1e5 + value AS snr,
    2.0 + (user_id % 11) AS vpd, CAST(user_id % 4 AS DOUBLE) / 3 AS lsm FROM events),
  u AS (SELECT event_id, t - 273.15 AS t, SQRT(u * u + v * v) * 4.87 / LN(67.8 * 10 - 5.42) AS w, snr / 1e6 AS rn, sp / 1000 AS p, vpd / 10 AS vpd, lsm FROM h),
  g AS (SELECT *, CASE WHEN lsm > 0.5 THEN CASE WHEN rn < 0 THEN rn * 0.1 ELSE rn * 0.5 END ELSE 0 END AS g, CASE WHEN rn < 0 THEN 0.24 ELSE 0.96 END AS cd,
    p * 1.013e-3 / (0.622 * 2.45) AS gamma, 4098.0 * 0.6108 * EXP(17.27 * t / (t + 237.3)) / ((t + 237.3) * (t + 237.3)) AS slope FROM u)"""


@query(f"WITH {_PETV} SELECT event_id, {r('0 - GREATEST(0.0, (0.408 * slope * (rn - g) + gamma * (37 / (t + 273)) * w * vpd) / (slope + gamma * (1 + cd * w)))')} + 0.0 AS pet FROM g")
def pet_hourly(spark, d):
    e, u = views.table(spark, d, "events"), F.col("user_id")
    pet = reference_evapotranspiration(F.lit(283.15) + F.col("value") / 20, (u % 7) / 2.0, (u % 5) / 3.0, F.lit(100000.0) - F.col("value") * 5, (F.hour("ts") - 8) * F.lit(1e5) + F.col("value"), F.lit(2.0) + u % 11, (u % 4) / 3.0)
    return e.select("event_id", (pet + 0.0).alias("pet"))


PROBS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
_P = "[" + ", ".join(map(str, PROBS)) + "]"
_Q = "SELECT {by}, CAST(p AS DOUBLE) AS quantile, {v} AS value FROM (SELECT {by}, UNNEST(" + _P + ") AS p, UNNEST(quantile_cont({x}, " + _P + ")) AS q FROM {src} {where} GROUP BY {by})"


@query(f"WITH {GRID} " + _Q.format(by="ilon, ilat", v=r("q"), x="t2m", src="grid", where="WHERE time BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"))
def quantile_ref(spark, d):
    ref = views.grid_daily(spark, d).where(F.col("time").between(F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date")))
    return quantiles.group_quantiles(ref, F.col("t2m"), PROBS, ["ilon", "ilat"])


@query(f"WITH {GRID} " + _Q.format(by="ilon, ilat", v=r("q"), x="tp", src="grid", where="WHERE tp > 0.003"))
def quantile_rain_days(spark, d):
    return quantiles.group_quantiles(views.grid_daily(spark, d), F.col("tp"), PROBS, ["ilon", "ilat"], F.col("tp") > 0.003)


@query(f"WITH {GRID} " + _Q.format(by="year", v=r("q"), x="t2m", src="(SELECT CAST(YEAR(time) AS INT) AS year, t2m FROM grid)", where=""))
def quantile_by_year(spark, d):
    return selection.exact_quantiles(views.grid_daily(spark, d).withColumn("year", F.year("time")), F.col("t2m"), PROBS, ["year"])


@query(f"""WITH {GRID}, axis AS (SELECT ilon, ilat, time, t2m, ROW_NUMBER() OVER ({CELL}) AS it, COUNT(*) OVER (PARTITION BY ilon, ilat) AS n FROM grid),
    anchor AS (SELECT ilon, ilat, it, n, strftime(time, '%m-%d') AS doy FROM axis
      UNION ALL SELECT ilon, ilat, it, n, '02-29' FROM axis WHERE strftime(time, '%m-%d') = '03-01' AND DAY(LAST_DAY(MAKE_DATE(YEAR(time), 2, 1))) = 28),
    pool AS (SELECT a.ilon, a.ilat, a.doy, x.t2m FROM anchor a, UNNEST(RANGE(-15, 16)) AS o(o) JOIN axis x ON x.ilon = a.ilon AND x.ilat = a.ilat AND x.it = (((a.it + o - 1) % a.n) + a.n) % a.n + 1)
    SELECT ilon, ilat, doy, CAST(p AS DOUBLE) AS quantile, {r('q')} AS value FROM (SELECT ilon, ilat, doy, UNNEST([0.1, 0.5, 0.9]) AS p, UNNEST(quantile_cont(t2m, [0.1, 0.5, 0.9])) AS q FROM pool GROUP BY ilon, ilat, doy)""")
def quantile_doy(spark, d):
    return quantiles.day_of_year_quantiles(views.grid_daily(spark, d), "t2m", [0.1, 0.5, 0.9])


@query(f"""WITH {GRID}, g AS (SELECT *, CAST(YEAR(time) AS INT) AS year FROM grid)
    SELECT year, {r('MIN(t2m)')} AS low, {r('quantile_cont(t2m, 0.25)')} AS q1, {r('quantile_cont(t2m, 0.5)')} AS median, {r('quantile_cont(t2m, 0.75)')} AS q3, {r('MAX(t2m)')} AS high FROM g GROUP BY year""")
def five_number(spark, d):
    return selection.exact_five_numbers(views.grid_daily(spark, d).withColumn("year", F.year("time")), F.col("t2m"), ["year"])


@query(f"""WITH {GRID}, {MASK}, c AS (SELECT *, CASE WHEN n_obs > 2 THEN 1 ELSE 0 END AS busy, LAG(CASE WHEN n_obs > 2 THEN 1 ELSE 0 END) OVER ({CELL}) AS before FROM grid),
    k AS (SELECT *, SUM(CASE WHEN busy = before THEN 0 ELSE 1 END) OVER ({CELL}) AS run FROM c),
    l AS (SELECT ilon, ilat, CAST(run AS BIGINT) AS run, ANY_VALUE(busy) AS busy, COUNT(*) AS run_length FROM k GROUP BY ilon, ilat, run)
    SELECT ilon, ilat, run, busy, run_length, CAST(COALESCE(SUM(run_length) OVER (PARTITION BY ilon, ilat ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM l""")
def run_length_offsets(spark, d):
    grid = views.grid_daily(spark, d).withColumn("busy", F.when(F.col("n_obs") > 2, 1).otherwise(0))
    return windows.run_offsets(grid, "busy", "time", ["ilon", "ilat"])
