"""Queries on boxes, points and lists of documented events."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacube.functions.columns import area_weight
from stratacube.jobs.declare import registrar
from stratacube.jobs.event_queries import labels
from stratacube.jobs.sql import EVENT, GRID, MASK, REF, components as components_sql, r
from stratacube.operators import stats, subset
from stratacube.sources import views

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)


@query(f"WITH {GRID} SELECT ilon, ilat, time, {r('t2m')} AS t2m FROM grid WHERE lon BETWEEN 60 AND 220 AND lat BETWEEN -30 AND 30 AND time BETWEEN DATE '1996-03-01' AND DATE '1999-09-30'")
def box_subset(spark, d):
    return subset.box(views.grid_daily(spark, d), (60, 220), (-30, 30), ("1996-03-01", "1999-09-30")).select("ilon", "ilat", "time", "t2m")


@query(f"WITH {REF} SELECT obs_event, {r('lon_from')} AS lon_from, {r('lon_to')} AS lon_to FROM boxes")
def box_lon_wrap(spark, d):
    return subset.split_boxes(views.ref_events(spark, d)).select("obs_event", "lon_from", "lon_to")


@query(f"WITH {REF} SELECT obs_event, CAST(FLOOR((west - 1) / 5) * 5 AS BIGINT) AS west, CAST(CEIL((east + 1) / 5) * 5 AS BIGINT) AS east, CAST(FLOOR((south - 1) / 5) * 5 AS BIGINT) AS south, CAST(CEIL((north + 1) / 5) * 5 AS BIGINT) AS north FROM ref")
def box_expand(spark, d):
    e = views.ref_events(spark, d)
    lo, hi = (lambda c: subset.expand_low(F.col(c)).alias(c)), (lambda c: subset.expand_high(F.col(c)).alias(c))
    return e.select("obs_event", lo("west"), hi("east"), lo("south"), hi("north"))


@query(f"WITH {GRID}, c AS (SELECT DISTINCT ilon, ilat, lon, lat FROM grid) SELECT ilon, ilat, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon, lat FROM c")
def lon_shift(spark, d):
    return views.grid_daily(spark, d).select("ilon", "ilat", subset.shift_longitude(F.col("lon")).alias("lon"), "lat").distinct()


_POINTS = "p AS (SELECT c_custkey AS name, (c_custkey * 7 % 360) + 0.5 AS plon, 75.0 - (c_custkey * 11 % 150) AS plat FROM customer)"


@query(f"""WITH {GRID}, c AS (SELECT DISTINCT ilon, ilat, lon, lat FROM grid), {_POINTS},
    hit AS (SELECT name, plon, plat, ilon, ilat, lon, lat, ROW_NUMBER() OVER (PARTITION BY name ORDER BY (lon - plon) * (lon - plon) + (lat - plat) * (lat - plat), ilon, ilat) AS k FROM p JOIN c ON ABS(lon - plon) <= 20 AND ABS(lat - plat) <= 20)
    SELECT name, {r('plon')} AS plon, {r('plat')} AS plat, ilon, ilat, lon, lat FROM hit WHERE k = 1""")
def point_lookup(spark, d):
    cells = views.grid_daily(spark, d).select("ilon", "ilat", "lon", "lat").distinct()
    k = F.col("c_custkey")
    points = views.table(spark, d, "customer").select(k.alias("name"), ((k * 7 % 360) + 0.5).alias("plon"), (F.lit(75.0) - (k * 11 % 150)).alias("plat"))
    return subset.nearest_cell(cells, points, 20.0).select("name", "plon", "plat", "ilon", "ilat", "lon", "lat")


def _in_boxes(cube, spark, d):
    """Rows of the cube inside a documented event's days and boxes."""
    boxes = subset.split_boxes(views.ref_events(spark, d)).select("obs_event", "start", "end", "south", "north", "lon_from", "lon_to")
    return subset.in_boxes(cube, boxes)


_INSIDE = "time BETWEEN start_ AND end_ AND lat BETWEEN south AND north AND lon BETWEEN lon_from AND lon_to"


@query(f"WITH {GRID}, {REF} SELECT obs_event, ilon, ilat, time, {r('t2m')} AS t2m FROM grid JOIN boxes ON {_INSIDE}")
def event_range_join(spark, d):
    return _in_boxes(views.grid_daily(spark, d), spark, d).select("obs_event", "ilon", "ilat", "time", "t2m")


@query(f"""WITH RECURSIVE {components_sql(True)}, {REF}, s AS (SELECT label, MIN(time) AS start_time, MAX(time) AS end_time, COUNT(*) AS n FROM voxel GROUP BY label)
    SELECT * FROM s WHERE label IN (SELECT label FROM voxel JOIN boxes ON {_INSIDE})""")
def event_semi_join(spark, d):
    v = labels(spark, d)
    s = v.groupBy("label").agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count("*").alias("n"))
    return s.join(_in_boxes(v, spark, d).select("label").distinct(), "label", "left_semi")


@query(f"""WITH RECURSIVE {components_sql(True)}, {REF}, s AS (SELECT label, MIN(time) AS a, MAX(time) AS b FROM voxel GROUP BY label)
    SELECT obs_event, label, a AS start_time, b AS end_time FROM s JOIN ref ON a <= end_ AND b >= start_""")
def interval_overlap(spark, d):
    s = labels(spark, d).groupBy("label").agg(F.min("time").alias("a0"), F.max("time").alias("a1"))
    e = views.ref_events(spark, d).select("obs_event", F.col("start").alias("b0"), F.col("end").alias("b1"))
    return subset.overlapping(s, e).select("obs_event", "label", F.col("a0").alias("start_time"), F.col("a1").alias("end_time"))


_W = "COS(RADIANS(lat))"


@query(f"""WITH {EVENT}, {REF}, b AS (SELECT * FROM event JOIN boxes ON {_INSIDE} WHERE event > 0 AND event < 16)
    SELECT obs_event, MIN(time) AS start_time, MAX(time) AS end_time, {r(f'SUM(t2mmax * {_W}) / SUM({_W})')} AS t2mmax_mean, {r(f'SUM(CASE WHEN (event & 1) <> 0 THEN {_W} ELSE 0 END)')} AS heat,
    {r(f'SUM(CASE WHEN (event & 2) <> 0 THEN {_W} ELSE 0 END)')} AS drought30, {r(f'SUM({_W})')} AS volume FROM b GROUP BY obs_event""")
def ref_event_stats(spark, d):
    inside = _in_boxes(views.grid_event(spark, d), spark, d).where("event > 0 AND event < 16")
    w = area_weight(F.col("lat"))
    s = inside.groupBy("obs_event").agg(*stats.bounds(), *stats.measures(["t2mmax"], w), *stats.type_areas(F.col("event"), w), F.sum(w).alias("volume"))
    return s.select("obs_event", "start_time", "end_time", "t2mmax_mean", "heat", "drought30", "volume")


@query(f"WITH {GRID}, {MASK} SELECT ilon, ilat, time, {r('t2m')} AS t2m, {r('lsm')} AS lsm, cont FROM grid LEFT JOIN mask USING (ilon, ilat) WHERE lsm > 0.5")
def land_cells(spark, d):
    """The cube on land: the static mask, one row per cell, is joined to every day."""
    m = views.mask(spark, d)
    return views.grid_daily(spark, d).join(m, ["ilon", "ilat"], "left").where("lsm > 0.5").select("ilon", "ilat", "time", "t2m", "lsm", "cont")
