"""Queries on event codes, runs, neighbourhoods and components."""

from __future__ import annotations

import operator

from pyspark.sql import functions as F

from stratacube.jobs.declare import registrar
from stratacube.jobs.sql import EVENT, GRID, HOURLY, PEI, RANKS, RUNS, components as components_sql, r
from stratacube.operators import components, events, neighbours, windows
from stratacube.operators.label_store import LabelStore
from stratacube.sources import views
from stratacube.sources.workspace import Workspace, stored

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)


@query(f"""WITH {EVENT}, y AS (SELECT CAST(YEAR(time) AS INT) AS year, event, COUNT(*) AS days FROM event GROUP BY 1, 2)
    SELECT year, event, days, {r('days * 100.0 / SUM(days) OVER (PARTITION BY year)')} AS share FROM y""")
def event_code_share(spark, d):
    """Flagship: days in each event code per year, and their share of the year."""
    counts = views.grid_event(spark, d).groupBy(F.year("time").alias("year"), "event").agg(F.count("*").alias("days"))
    return windows.share_of_total(counts, "days", "share", ["year"])


@query(f"WITH {EVENT} SELECT ilon, ilat, time, event FROM event")
def event_code(spark, d):
    return views.grid_event(spark, d).select("ilon", "ilat", "time", "event")


@query(f"WITH {RANKS} SELECT ilon, ilat, time, (CASE WHEN rt < 0.05 THEN 1 ELSE 0 END | CASE WHEN rd30 < 0.2 THEN 2 ELSE 0 END | CASE WHEN pei_90 > 3 THEN 4 ELSE 0 END) AS event FROM ranks")
def event_code_per_layer(spark, d):
    code = events.event_code([F.col("rt"), F.col("rd30"), F.round(F.col("pei_90"), 9)], [0.05, 0.2, 3.0], compare=[operator.lt, operator.lt, operator.gt])
    return views.grid_ranks(spark, d).select("ilon", "ilat", "time", code.alias("event"))


@query(f"WITH {EVENT} SELECT ilon, ilat, time, ((event & 1) <> 0 AND (event & 14) <> 0) AS compound, (event > 0 AND event < 16) AS extreme FROM event")
def compound_mask(spark, d):
    e = F.col("event")
    return views.grid_event(spark, d).select("ilon", "ilat", "time", events.is_compound(e).alias("compound"), events.is_extreme(e).alias("extreme"))


@query(f"""WITH {EVENT} SELECT event, CASE WHEN event = 1 THEN 'hot' WHEN event % 2 = 0 THEN 'dry' ELSE 'hot+dry' END AS kind, COUNT(*) AS days FROM event WHERE event > 0 AND event < 16 GROUP BY 1, 2""")
def macro_type(spark, d):
    e = views.grid_event(spark, d).where(events.is_extreme(F.col("event")))
    return e.groupBy("event", events.macro_type(F.col("event")).alias("kind")).agg(F.count("*").alias("days"))


_NAMED = ", ".join(f"CASE WHEN (event & {1 << i}) <> 0 THEN '{n}' END" for i, n in enumerate(events.LAYERS))


@query(f"WITH {EVENT} SELECT concat_ws('_', {_NAMED}) AS name, COUNT(*) AS days FROM event WHERE event < 16 GROUP BY 1")
def code_label(spark, d):
    e = views.grid_event(spark, d).where("event < 16")
    return e.groupBy(events.code_label(F.col("event")).alias("name")).agg(F.count("*").alias("days"))


@query(f"WITH {EVENT} SELECT ilon, ilat, time, (event & 1) <> 0 AS heat, (event & 2) <> 0 AS d30, (event & 4) <> 0 AS d90, (event & 8) <> 0 AS d180 FROM event")
def code_flags(spark, d):
    return events.code_flags(views.grid_event(spark, d)).select("ilon", "ilat", "time", "heat", "d30", "d90", "d180")


@query(f"""WITH {HOURLY}, {PEI}, roll AS (SELECT ilon, CAST(ts AS DATE) AS day, SUM(tp) OVER (PARTITION BY ilon ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) AS rs FROM hourly),
    rain AS (SELECT ilon, day, ROUND(MAX(rs), 6) AS msp FROM roll GROUP BY ilon, day), thr AS (SELECT ilon, quantile_cont(msp, 0.8) AS q FROM rain GROUP BY ilon),
    wet AS (SELECT rain.ilon, rain.day, (msp > q AND msp > 0.00786) AS heavy, ROW_NUMBER() OVER (PARTITION BY rain.ilon ORDER BY rain.day) AS k FROM rain JOIN thr USING (ilon)),
    dry AS (SELECT ilon, ROUND(pei_30, 9) AS p30, ROUND(pei_90, 9) AS p90, ROUND(pei_180, 9) AS p180, ROW_NUMBER() OVER (PARTITION BY ilon ORDER BY time) AS k FROM pei WHERE ilat = 0),
    lim AS (SELECT ilon, quantile_cont(p30, 0.4) AS q30, quantile_cont(p90, 0.4) AS q90, quantile_cont(p180, 0.4) AS q180 FROM dry GROUP BY ilon),
    back AS (SELECT dry.*, q90, q180, COALESCE(MIN(CASE WHEN p30 < q30 THEN 1 ELSE 0 END) OVER (PARTITION BY ilon ORDER BY k ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), CASE WHEN p30 < q30 THEN 1 ELSE 0 END) AS was FROM dry JOIN lim USING (ilon))
    SELECT w.ilon, w.day AS time, (CASE WHEN heavy THEN 1 ELSE 0 END | CASE WHEN was = 1 THEN 2 ELSE 0 END | CASE WHEN p90 < q90 THEN 4 ELSE 0 END | CASE WHEN p180 < q180 THEN 8 ELSE 0 END) AS event
    FROM wet w JOIN back b ON w.ilon = b.ilon AND w.k = b.k""")
def heavy_rain_code(spark, d):
    """Heavy rain after dry spells: hourly rain of a cell beside the daily balances of its twin on the grid's first row.

    The k-th day of the one is paired with the k-th day of the other, as the two series come from different tables.
    """
    from pyspark.sql import Window

    rolled = windows.rolling_sum(views.hourly(spark, d), F.col("tp"), 12, 11, "rs", "ts", ("ilon",))
    rain = rolled.groupBy("ilon", F.to_date("ts").alias("time")).agg(F.round(F.max("rs"), 6).alias("msp"))
    rain = rain.join(rain.groupBy("ilon").agg(F.percentile("msp", 0.8).alias("q")), "ilon")
    wet = rain.select("ilon", "time", ((F.col("msp") > F.col("q")) & (F.col("msp") > 0.00786)).alias("heavy"), F.row_number().over(Window.partitionBy("ilon").orderBy("time")).alias("k"))
    pei = views.grid_ranks(spark, d).where("ilat = 0").select("ilon", "time", *(F.round(f"pei_{n}", 9).alias(f"p{n}") for n in (30, 90, 180)))
    dry = pei.join(pei.groupBy("ilon").agg(*(F.percentile(f"p{n}", 0.4).alias(f"q{n}") for n in (30, 90, 180))), "ilon").withColumn("k", F.row_number().over(Window.partitionBy("ilon").orderBy("time")))
    dry = windows.rolling_all(dry, F.col("p30") < F.col("q30"), -5, -1, "was", "k", ("ilon",)).drop("time")
    layers = [F.when(c, 0).otherwise(1) for c in (F.col("heavy"), F.col("was"), F.col("p90") < F.col("q90"), F.col("p180") < F.col("q180"))]
    return wet.join(dry, ["ilon", "k"]).select("ilon", "time", events.event_code(layers, 1).alias("event"))


@query(f"WITH {RUNS} SELECT d.ilon, d.ilat, d.time FROM dry d JOIN kept k ON d.ilon = k.ilon AND d.ilat = k.ilat AND d.time BETWEEN k.t0 AND k.t1")
def min_run_filter(spark, d):
    return windows.min_run_filter(views.dry_days(spark, d), views.period(spark, d)).select("ilon", "ilat", "time")


@query(f"WITH {RUNS} SELECT d.ilon, d.ilat, d.time FROM dry d JOIN runs k ON d.ilon = k.ilon AND d.ilat = k.ilat AND d.time BETWEEN k.t0 AND k.t1 WHERE k.n >= 4")
def min_run_filter_strict(spark, d):
    return windows.min_run_filter(views.dry_days(spark, d), views.period(spark, d), edge="strict").select("ilon", "ilat", "time")


_NEAR = "JOIN (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dx,dy) ON TRUE"
_COUNT = f"""near AS (SELECT ilon, ilat, time, COUNT(*) AS n FROM (SELECT (d.ilon - dx + 5) % 5 AS ilon, d.ilat - dy AS ilat, d.time FROM dry d {_NEAR}) GROUP BY ALL)"""


@query(f"WITH {RUNS}, {_COUNT} SELECT d.ilon, d.ilat, d.time, n.n FROM dry d JOIN near n ON d.ilon = n.ilon AND d.ilat = n.ilat AND d.time = n.time WHERE n.n >= 2")
def diamond_filter(spark, d):
    return neighbours.diamond_filter(views.dry_days(spark, d), 2, 3, views.NLON).select("ilon", "ilat", "time", "n")


@query(f"""WITH {RUNS}, {_COUNT}, core AS (SELECT ilon, ilat, time FROM near WHERE n = 5),
    grown AS (SELECT DISTINCT (c.ilon - dx + 5) % 5 AS ilon, c.ilat - dy AS ilat, c.time FROM core c {_NEAR})
    SELECT d.ilon, d.ilat, d.time FROM dry d JOIN grown g ON d.ilon = g.ilon AND d.ilat = g.ilat AND d.time = g.time""")
def opening(spark, d):
    return neighbours.opening(views.dry_days(spark, d), 3, views.NLON).select("ilon", "ilat", "time")


@query(f"""WITH {EVENT}, seen AS (SELECT (e.ilon - dx + 5) % 5 AS ilon, e.ilat - dy AS ilat, e.time, e.event, COUNT(*) AS n FROM event e {_NEAR} GROUP BY ALL),
    best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ilon, ilat, time ORDER BY n DESC, event) AS k FROM seen)
    SELECT e.ilon, e.ilat, e.time, e.event, b.event AS mode FROM event e JOIN best b ON e.ilon = b.ilon AND e.ilat = b.ilat AND e.time = b.time WHERE b.k = 1""")
def window_mode(spark, d):
    cube = views.grid_event(spark, d).select("ilon", "ilat", "time", "event")
    return neighbours.window_mode(cube, "event", 3, views.NLON)


def _values(offsets) -> str:
    return ", ".join(f"({dx},{dy},{dt},{k})" for k, (dx, dy, dt) in enumerate((*o, 0)[:3] for o in offsets))


def _near3(name: str, offsets, source: str = "dry", more: str = "") -> str:
    """Rows of ``source`` seen from every cell and day that has them in its neighbourhood."""
    return f"{name} AS (SELECT (d.ilon - dx + 5) % 5 AS ilon, d.ilat - dy AS ilat, d.time - dt AS time, place{more} FROM {source} d JOIN (VALUES {_values(offsets)}) o(dx,dy,dt,place) ON TRUE)"


@query(f"""WITH {RUNS}, {_COUNT} SELECT d.ilon, d.ilat, d.time, n.n FROM dry d JOIN near n ON d.ilon = n.ilon AND d.ilat = n.ilat AND d.time = n.time
    JOIN runs k ON d.ilon = k.ilon AND d.ilat = k.ilat AND d.time BETWEEN k.t0 AND k.t1 WHERE n.n >= 2 AND k.n >= 4""")
def diamond_min_run(spark, d):
    """Dry days with a dry neighbour on the day itself and in a dry spell of four days."""
    out = neighbours.diamond_run_filter(views.dry_days(spark, d).select("ilon", "ilat", "time"), 2, 4, views.period(spark, d), 3, views.NLON)
    return out.select("ilon", "ilat", "time", "n")


@query(f"""WITH {RUNS}, {_near3('seen', neighbours.diamond(3, 3, 5))}, near AS (SELECT ilon, ilat, time, COUNT(*) AS n FROM seen GROUP BY ALL)
    SELECT d.ilon, d.ilat, d.time, n.n FROM dry d JOIN near n ON d.ilon = n.ilon AND d.ilat = n.ilat AND d.time = n.time WHERE n.n >= 6""")
def diamond_count_3d(spark, d):
    """Dry days with six dry days in the diamond of three by three cells and five days."""
    return neighbours.diamond_filter(views.dry_days(spark, d), 6, (3, 3, 5), views.NLON).select("ilon", "ilat", "time", "n")


_CROSS = neighbours.diamond(3, 3, 3)


@query(f"""WITH {RUNS}, {_near3('seen', _CROSS)}, near AS (SELECT ilon, ilat, time, COUNT(*) AS n FROM seen GROUP BY ALL),
    room AS (SELECT d.ilon, d.ilat, d.time, SUM(CASE WHEN d.ilat + dy BETWEEN 0 AND 4 AND d.time + dt BETWEEN first AND last THEN 1 ELSE 0 END) AS room FROM dry d, period, (VALUES {_values(_CROSS)}) o(dx,dy,dt,place) GROUP BY ALL),
    core AS (SELECT r.ilon, r.ilat, r.time FROM room r JOIN near n ON r.ilon = n.ilon AND r.ilat = n.ilat AND r.time = n.time WHERE n = room), {_near3('grown', _CROSS, 'core')}
    SELECT d.ilon, d.ilat, d.time FROM dry d JOIN (SELECT DISTINCT ilon, ilat, time FROM grown) g ON d.ilon = g.ilon AND d.ilat = g.ilat AND d.time = g.time""")
def opening_3d(spark, d):
    """Opening of the dry days by the cross of face neighbours in space and time, clipped at the ends of grid and period."""
    return neighbours.opening_clipped(views.dry_days(spark, d), (3, 3, 3), views.NLAT, views.period(spark, d), views.NLON).select("ilon", "ilat", "time")


@query(f"""WITH {EVENT}, {_near3('seen', neighbours.box(3, 3, 5), 'event', ', event')}, n AS (SELECT ilon, ilat, time, event, COUNT(*) AS n, MAX(place) AS last FROM seen GROUP BY ilon, ilat, time, event),
    best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ilon, ilat, time ORDER BY n DESC, last) AS k FROM n)
    SELECT e.ilon, e.ilat, e.time, e.event, CASE WHEN e.event > 0 AND e.event < 16 THEN b.event ELSE 0 END AS mode FROM event e JOIN best b ON e.ilon = b.ilon AND e.ilat = b.ilat AND e.time = b.time WHERE b.k = 1""")
def window_mode_3d(spark, d):
    """Most frequent code in the box of three by three cells and five days around each extreme day; 0 on other days."""
    cube = views.grid_event(spark, d).select("ilon", "ilat", "time", "event")
    return neighbours.box_mode(cube, "event", (3, 3, 5), views.NLON, events.is_extreme(F.col("event")))


def filtered(spark, d):
    """Dry days that pass the minimum-run filter."""
    return windows.min_run_filter(views.dry_days(spark, d), views.period(spark, d))


def labelled(spark, d, wrap=True):
    return components.label_components(filtered(spark, d), views.NLON, views.NLAT, wrap)


def labels(spark, d):
    """The labelled cube as a stored layer, which the statistics share."""
    sources = [views.table(spark, d, t) for t in ("lineitem", "supplier")]
    return stored(spark, "labels", sources, lambda: labelled(spark, d))


@query(f"WITH RECURSIVE {components_sql(False)} SELECT ilon, ilat, time, label FROM voxel")
def components_plain(spark, d):
    return labelled(spark, d, False).select("ilon", "ilat", "time", "label")


@query(f"WITH RECURSIVE {components_sql(True)} SELECT ilon, ilat, time, label FROM voxel")
def components_wrap(spark, d):
    return labelled(spark, d).select("ilon", "ilat", "time", "label")


@query(f"WITH RECURSIVE {components_sql(True)} SELECT ilon, ilat, time, label FROM voxel")
def components_tiled(spark, d):
    """Labelled year by year and merged across the seams: the same labels as all at once."""
    days = filtered(spark, d).withColumn("tile", F.year("time"))
    return components.label_by_tiles(days, "tile", views.NLON, views.NLAT).select("ilon", "ilat", "time", "label")


@query(f"WITH RECURSIVE {components_sql(True)} SELECT ilon, ilat, time, label FROM voxel")
def labels_by_append(spark, d):
    """The labels of all days from a store that is begun with the years to 1996 and then grows by the later years."""
    ws = Workspace(spark, "labels_by_append")
    days = ws.save(filtered(spark, d).select("ilon", "ilat", "time"), "days")
    store = LabelStore(spark, f"{ws.path}/store", views.NLON, views.NLAT)
    for some in ("year(time) <= 1996", "year(time) = 1997", "year(time) >= 1998"):
        store.append(days.where(some))
    return store.voxels(numbered=True)


@query(f"WITH RECURSIVE {components_sql(True)} SELECT CAST(YEAR(time) AS INT) AS tile, MAX(label) AS n_labels FROM voxel GROUP BY 1")
def tile_max_label(spark, d):
    return labels(spark, d).groupBy(F.year("time").alias("tile")).agg(F.max("label").alias("n_labels"))


@query(f"""WITH {GRID}, t AS (SELECT UNNEST(RANGE(1995, 2002)) AS owner) SELECT owner, CAST(owner AS VARCHAR) || '+1' AS tile, CAST(YEAR(time) AS BIGINT) = owner AS owned, COUNT(*) AS days
    FROM grid JOIN t ON YEAR(time) BETWEEN owner AND owner + 1 GROUP BY 1, 2, 3""")
def tile_periods(spark, d):
    """Two-year tiles that overlap by a year; each day belongs to the tile of its own year."""
    y = F.year("time").cast("long")
    spread = views.grid_daily(spark, d).select(y.alias("y"), F.explode(F.sequence(F.greatest(y - 1, F.lit(1995)), y)).alias("owner")).where("owner <= 2001")
    return spread.groupBy("owner", F.concat(F.col("owner").cast("string"), F.lit("+1")).alias("tile"), (F.col("y") == F.col("owner")).alias("owned")).agg(F.count("*").alias("days"))
