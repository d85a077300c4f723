"""Queries on statistics per event, year, continent and cell, and on trends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratacube.functions.columns import area_weight, wmean
from stratacube.jobs.declare import registrar
from stratacube.jobs.event_queries import labels
from stratacube.jobs.sql import EVENT, GRID, MASK, RANKS, YEARS, components as components_sql, r
from stratacube.operators import kernels, regression, selection, states, stats, subset, trends
from stratacube.sources import views
from stratacube.sources.layout import CubeLayout
from stratacube.sources.workspace import Workspace

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)

W = "COS(RADIANS(lat))"
_JOINED = f"""{components_sql(True)}, code AS (SELECT ilon, ilat, time, rt, rd30, rd90, rd180,
    (CASE WHEN rt < 0.1 THEN 1 ELSE 0 END | CASE WHEN rd30 < 0.1 THEN 2 ELSE 0 END | CASE WHEN rd90 < 0.1 THEN 4 ELSE 0 END | CASE WHEN rd180 < 0.1 THEN 8 ELSE 0 END) AS event FROM ranks),
    {MASK}, full_ AS (SELECT v.*, c.event, c.rt, c.rd30, c.rd90, c.rd180, m.lsm, m.cont FROM voxel v JOIN code c USING (ilon, ilat, time) JOIN mask m USING (ilon, ilat))"""


def _voxels(spark, d):
    """Labelled days joined with codes, ranks and the static layers."""
    from stratacube.operators.events import event_code

    code = event_code([F.col(c) for c in ("rt", "rd30", "rd90", "rd180")], 0.1)
    layers = views.grid_ranks(spark, d).select("ilon", "ilat", "time", "rt", "rd30", "rd90", "rd180", code.alias("event"))
    return labels(spark, d).join(layers, ["ilon", "ilat", "time"]).join(views.mask(spark, d), ["ilon", "ilat"])


_BOUNDS = "MIN(time) AS start_time, MAX(time) AS end_time, MIN(lon) AS longitude_min, MAX(lon) AS longitude_max, MIN(lat) AS latitude_min, MAX(lat) AS latitude_max"


def _mean(c: str, shift: float = 0.0) -> str:
    return r(f"SUM({c} * {W}) / SUM({W}) - {shift}")


def _area(test: str) -> str:
    return f"SUM(CASE WHEN {test} THEN {W} ELSE 0 END)"


def _pct(test: str) -> str:
    return f"round_even({_area(test)} / SUM({W}) * 100 * 100, 0) / 100"


@query(f"""WITH RECURSIVE {_JOINED} SELECT label, {_BOUNDS}, {_mean('t2mmax', 273.15)} AS t2mmax_mean, {r('MIN(t2mmax) - 273.15')} AS t2mmax_min, {r('MAX(t2mmax) - 273.15')} AS t2mmax_max,
    {_mean('pei_30')} AS pei_30_mean, {r('MIN(pei_30)')} AS pei_30_min, {r('MAX(pei_30)')} AS pei_30_max, {_pct('(event & 1) <> 0')} AS heat, {_pct('(event & 2) <> 0')} AS drought30,
    {_pct('(event & 4) <> 0')} AS drought90, {_pct('(event & 8) <> 0')} AS drought180, {_pct('event > 1 AND event % 2 = 1')} AS compound, {_pct('lsm > 0.5')} AS land_area,
    {r(f'SUM({W})')} AS volume, CAST(MAX(time) - MIN(time) + 1 AS INT) AS duration, {r(f'SUM({W}) / (MAX(time) - MIN(time) + 1)')} AS area
    FROM full_ WHERE lsm > 0.5 GROUP BY label""")
def event_stats(spark, d):
    s = stats.event_statistics(_voxels(spark, d), ["t2mmax", "pei_30"])
    return stats.derive(s, kelvin=["t2mmax_mean", "t2mmax_min", "t2mmax_max"], shares=["heat", "drought30", "drought90", "drought180", "compound", "land_area"])


def _depth(c: str) -> str:
    return r(f"SUM(0.1 - LEAST({c}, 0.1) * {W})")


@query(f"""WITH RECURSIVE {_JOINED} SELECT label, {_depth('rt')} AS inth, {_depth('rd30')} AS intd30, {_depth('rd90')} AS intd90, {_depth('rd180')} AS intd180, {r(f'SUM({W})')} AS volume
    FROM full_ WHERE lsm > 0.5 GROUP BY label""")
def event_intensity(spark, d):
    ranks = {"inth": "rt", "intd30": "rd30", "intd90": "rd90", "intd180": "rd180"}
    return stats.event_statistics(_voxels(spark, d), [], ranks, limit=0.1).select("label", *ranks, "volume")


@query(f"""WITH RECURSIVE {components_sql(True)} SELECT label, {_BOUNDS}, {_mean('t2mmax')} AS t2mmax_mean, {r('MIN(t2mmax)')} AS t2mmax_min, {r('MAX(t2mmax)')} AS t2mmax_max,
    {r(f'SUM({W})')} AS volume, CAST(MAX(time) - MIN(time) + 1 AS INT) AS duration, {r(f'SUM({W}) / (MAX(time) - MIN(time) + 2)')} AS area FROM voxel GROUP BY label""")
def tair_stats(spark, d):
    return stats.derive(stats.event_statistics(labels(spark, d), ["t2mmax"], code=None, land=None), "plus_two")


@query(f"""WITH RECURSIVE {components_sql(True)} SELECT label, {_BOUNDS}, COUNT(*) AS n, {r(f'SUM({W})')} AS volume, CAST(MAX(time) - MIN(time) AS INT) AS duration,
    {r(f'SUM({W}) / (MAX(time) - MIN(time) + 1)')} AS area FROM voxel GROUP BY label""")
def label_count(spark, d):
    v = labels(spark, d)
    s = v.groupBy("label").agg(*stats.bounds(), F.count("*").alias("n"), F.sum(area_weight(F.col("lat"))).alias("volume"))
    return stats.derive(s, "exclusive")


NINE = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
_NINE = "[" + ", ".join(f"CAST({p} AS DOUBLE)" for p in NINE) + "]"


@query(f"""WITH RECURSIVE {components_sql(True)}, s AS (SELECT SUM({W}) AS volume, CAST(MAX(time) - MIN(time) + 1 AS DOUBLE) AS duration FROM voxel GROUP BY label),
    l AS (SELECT 'volume' AS variable, volume AS v FROM s UNION ALL SELECT 'duration', duration FROM s UNION ALL SELECT 'area', volume / duration FROM s),
    q AS (SELECT variable, UNNEST({_NINE}) AS quantile, UNNEST(quantile_cont(v, {_NINE})) AS q FROM l GROUP BY variable)
    SELECT variable, quantile, {r('q')} AS value FROM q""")
def event_quantiles(spark, d):
    """Nine quantiles of duration, area and volume over all events."""
    s = labels(spark, d).groupBy("label").agg(*stats.bounds(), F.sum(area_weight(F.col("lat"))).alias("volume"))
    s = stats.derive(s).select("volume", F.col("duration").cast("double").alias("duration"), "area")
    return selection.exact_quantiles(s.unpivot([], s.columns, "variable", "v"), F.col("v"), NINE, ["variable"])


_ONSETS = f"""{components_sql(True)}, s AS (SELECT CAST(YEAR(MIN(time)) AS DOUBLE) AS x, LOG10(SUM({W})) AS y FROM voxel GROUP BY label)"""


def _onsets(spark, d):
    """(x, y) of every event: year of its onset and log10 of its volume."""
    size = labels(spark, d).groupBy("label").agg(F.min("time").alias("t"), F.sum(area_weight(F.col("lat"))).alias("volume"))
    return size.select(F.year("t").cast("double").alias("x"), F.log10("volume").alias("y"))


@query(f"""WITH RECURSIVE {_ONSETS}, n AS (SELECT x AS u, y / 0.15 AS v FROM s), c AS (SELECT *, FLOOR(u + 0.5) AS au, FLOOR(v / 1.5 + 0.5) * 1.5 AS av, FLOOR(u) + 0.5 AS bu, FLOOR(v / 1.5) * 1.5 + 0.75 AS bv FROM n),
    h AS (SELECT *, (u - au) * (u - au) + (v - av) * (v - av) * 4 / 3 <= (u - bu) * (u - bu) + (v - bv) * (v - bv) * 4 / 3 AS first FROM c)
    SELECT CASE WHEN first THEN au ELSE bu END AS cx, {r('CASE WHEN first THEN av ELSE bv END * 0.15')} AS cy, COUNT(*) AS n FROM h GROUP BY ALL""")
def hexbin(spark, d):
    """Events in hexagons of year of onset by size."""
    return stats.histogram_hexagons(_onsets(spark, d), F.col("x"), F.col("y"), 1.0, 0.15)


@query(f"""WITH RECURSIVE {_ONSETS}, p AS (SELECT *, ROW_NUMBER() OVER (ORDER BY x, y) AS i FROM (SELECT DISTINCT x, y FROM s)),
    lines AS (SELECT a.i, b.i AS j, (b.y - a.y) / (b.x - a.x) AS slope, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS icept FROM p a JOIN p b ON a.x < b.x),
    rest AS (SELECT i, j, SUM(GREATEST(s.y - slope * s.x - icept, 0)) AS up, SUM(GREATEST(slope * s.x + icept - s.y, 0)) AS down FROM lines, s GROUP BY i, j)
    SELECT q AS quantile, {r('MIN(q * up + (1 - q) * down)')} AS loss FROM rest, UNNEST({_NINE}) AS t(q) GROUP BY q""")
def event_regression_loss(spark, d):
    """Loss of nine quantile lines of size against year of onset over all events, one group; the SQL tries every line through two points."""
    points = _onsets(spark, d).withColumn("all", F.lit(1))
    lines = regression.large_quantile_regression(points, "x", "y", ["all"], NINE, most_points=64)
    return trends.pinball_loss(points, lines, "x", "y", ["all"]).drop("all")


_SIZES_SQL = f"size AS (SELECT label, SUM(round_even({W} * 1e9, 0)) AS volume FROM voxel GROUP BY label)"
_FLUX = {"gpp": "tp * 1e3", "nee": "pet - t2m / 100", "ter": "t2mmin / 10"}


@query(f"""WITH RECURSIVE {components_sql(True)}, flux AS (SELECT ilon, ilat, time, lat AS la, {', '.join(f'{e} AS {n}' for n, e in _FLUX.items())} FROM grid)
    SELECT label, {', '.join(f"{r(f'SUM({n} * COS(RADIANS(la))) / SUM(COS(RADIANS(la)))')} AS {n}_mean, {r(f'MIN({n})')} AS {n}_min, {r(f'MAX({n})')} AS {n}_max" for n in _FLUX)}
    FROM voxel JOIN flux USING (ilon, ilat, time) GROUP BY label""")
def flux_stats(spark, d):
    """Mean and range of three fluxes in each event; the fluxes stand in from the grid's own layers."""
    flux = views.grid_daily(spark, d).select("ilon", "ilat", "time", *(F.expr(e).alias(n) for n, e in _FLUX.items()))
    s = stats.event_statistics(labels(spark, d).join(flux, ["ilon", "ilat", "time"]), list(_FLUX), code=None, land=None)
    return s.select("label", *(f"{n}_{k}" for n in _FLUX for k in ("mean", "min", "max")))


@query(f"""WITH {GRID}, m AS (SELECT CAST(YEAR(time) AS INT) AS year, AVG(t2m) AS t2m, VAR_SAMP(t2m) AS t2mv, AVG(tp) AS tp, VAR_SAMP(tp) AS tpv, AVG(pet) AS pet FROM grid GROUP BY 1)
    SELECT year, 't2m' AS variable, 'mean' AS stat, {r('t2m - 273.15')} AS value FROM m UNION ALL SELECT year, 't2m', 'var', {r('t2mv')} FROM m UNION ALL SELECT year, 'tp', 'mean', {r('tp * 1e3')} FROM m
    UNION ALL SELECT year, 'tp', 'var', {r('tpv * 1e6')} FROM m UNION ALL SELECT year, 'pet', 'mean', {r('pet')} FROM m""")
def unit_rules(spark, d):
    """Yearly means and variances in the units of reports."""
    kinds = {"t2m mean": F.avg("t2m"), "t2m var": F.var_samp("t2m"), "tp mean": F.avg("tp"), "tp var": F.var_samp("tp"), "pet mean": F.avg("pet")}
    wide = views.grid_daily(spark, d).groupBy(F.year("time").alias("year")).agg(*(c.alias(n) for n, c in kinds.items()))
    long = wide.unpivot("year", list(kinds), "what", "value").select("year", F.split("what", " ")[0].alias("variable"), F.split("what", " ")[1].alias("stat"), "value")
    return stats.unit_rules(long)


_LAYERS = ["t2mmax", "t2m", "t2mmin", "tp", "pet", "pei_30", "pei_90", "pei_180"]
_RANKS = {"inth": "rt", "intd30": "rd30", "intd90": "rd90", "intd180": "rd180"}


def cube_layout(spark, d, buckets: int = 32):
    """The grid's layers, those computed from them, the labels and the mask, each stored in buckets by cell."""
    from stratacube.operators.events import event_code
    from stratacube.operators.indicators import water_balance
    from stratacube.operators.windows import rank_transform, running_mean

    cube = CubeLayout(spark, buckets)
    grid = cube.add("era", views.grid_daily(spark, d).select("ilon", "ilat", "time", "lon", "lat", *_LAYERS[:5]))
    pei = grid.select("ilon", "ilat", "time", water_balance(F.col("tp"), F.col("pet")).alias("wb"))
    for width in (30, 90, 180):
        pei = running_mean(pei, F.col("wb"), width, f"pei_{width}")
    cube.add("pei", pei.drop("wb"), dealt=True)
    ranked = rank_transform(cube.joined("era", "pei"), F.round(F.col("t2mmax"), 9), "rt", -1.0)
    for width in (30, 90, 180):
        ranked = rank_transform(ranked, F.round(F.col(f"pei_{width}"), 9), f"rd{width}")
    ranks = cube.add("ranks", ranked.select("ilon", "ilat", "time", *_RANKS.values()), dealt=True)
    cube.add("event", ranks.select("ilon", "ilat", "time", event_code([F.col(c) for c in _RANKS.values()], 0.1).alias("event")), dealt=True)
    cube.add("labels", labels(spark, d).select("ilon", "ilat", "time", "label"))
    cube.add("mask", views.mask(spark, d))
    return cube


@query(f"""WITH RECURSIVE {_JOINED}, every AS (SELECT f.ilon, f.ilat, f.time, f.lat, f.label, f.event, f.rt, f.rd30, f.rd90, f.rd180, f.lsm, {', '.join(f'k.{c}' for c in _LAYERS)} FROM full_ f JOIN ranks k USING (ilon, ilat, time))
    SELECT label, {', '.join(f"{_mean(c)} AS {c}_mean, {r(f'MIN({c})')} AS {c}_min, {r(f'MAX({c})')} AS {c}_max" for c in _LAYERS)}, {r(_area('(event & 1) <> 0'))} AS heat, {r(_area('event > 1 AND event % 2 = 1'))} AS compound,
    {', '.join(f"{_depth(c)} AS {n}" for n, c in _RANKS.items())}, {r(f'SUM({W})')} AS volume FROM every WHERE lsm > 0.5 GROUP BY label""")
def layer_join_stats(spark, d):
    """Statistics of every event over fifteen layers, joined bucket by bucket."""
    s = stats.event_statistics(cube_layout(spark, d).joined(), _LAYERS, _RANKS, limit=0.1)
    return s.select("label", *(f"{c}_{k}" for c in _LAYERS for k in ("mean", "min", "max")), "heat", "compound", *_RANKS, "volume")


@query(f"""WITH RECURSIVE {components_sql(True)}, {_SIZES_SQL}, listed AS (SELECT label, ROW_NUMBER() OVER (ORDER BY volume DESC, label) AS i FROM size)
    SELECT ilon, ilat, time, label, CAST(i AS DOUBLE) AS colour FROM voxel LEFT JOIN (SELECT * FROM listed WHERE i <= 10) USING (label)""")
def label_index(spark, d):
    """Days of events with the colour index of their label, for the ten largest; the others have none."""
    v = labels(spark, d).select("ilon", "ilat", "lat", "time", "label")
    size = v.groupBy("label").agg(F.sum(F.rint(area_weight(F.col("lat")) * 1e9)).alias("volume"))
    listed = size.orderBy(F.desc("volume"), "label").limit(10).select("label", F.row_number().over(Window.orderBy(F.desc("volume"), "label")).alias("i"))  # ten rows
    return subset.index_in(v, listed, "label", "colour").drop("lat")


@query(f"""WITH RECURSIVE {components_sql(True)} SELECT ilon, ilat, CAST(YEAR(time) AS INT) AS year, MAX(label) AS label FROM voxel GROUP BY 1, 2, 3""")
def annual_max_label(spark, d):
    return labels(spark, d).groupBy("ilon", "ilat", F.year("time").alias("year")).agg(F.max("label").alias("label"))


_TOP = f"size AS (SELECT label, SUM(round_even({W} * 1e9, 0)) AS volume, MAX(time) - MIN(time) AS days FROM voxel GROUP BY label)"


@query(f"""WITH RECURSIVE {components_sql(True)}, {_TOP}, big AS (SELECT label, ROW_NUMBER() OVER (ORDER BY volume DESC, label) AS i FROM size), long AS (SELECT label, ROW_NUMBER() OVER (ORDER BY days DESC, label) AS i FROM size),
    hit AS (SELECT v.ilon, v.ilat, MIN(b.i) AS b, MIN(l.i) AS l FROM voxel v LEFT JOIN (SELECT * FROM big WHERE i <= 10) b ON v.label = b.label LEFT JOIN (SELECT * FROM long WHERE i <= 10) l ON v.label = l.label GROUP BY 1, 2)
    SELECT ilon, ilat, CAST(COALESCE(11 - b, 0) AS INT) AS largest, CAST(COALESCE(11 - l, 0) AS INT) AS longest FROM hit""")
def largest_longest_idx(spark, d):
    """Index of the ten largest and ten longest events in each cell that has any event (a top-ten report)."""
    v = labels(spark, d).select("ilon", "ilat", "lat", "time", "label")
    size = v.groupBy("label").agg(F.sum(F.rint(area_weight(F.col("lat")) * 1e9)).alias("volume"), F.datediff(F.max("time"), F.min("time")).alias("days"))
    out = None
    for name, by in (("largest", "volume"), ("longest", "days")):
        top = size.orderBy(F.desc(by), "label").limit(10)
        listed = top.select("label", F.row_number().over(Window.orderBy(F.desc(by), "label")).alias("i"))  # ten rows
        one = stats.listed_label(v, F.broadcast(listed), name).withColumn(name, F.col(name).cast("int"))
        out = one if out is None else out.join(one, ["ilon", "ilat"])
    return out


@query(f"""WITH {EVENT}, seen AS (SELECT ilon, ilat, event, COUNT(*) AS n, MIN(time) AS f FROM event GROUP BY 1, 2, 3),
    k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ilon, ilat ORDER BY CASE WHEN event = 0 THEN 1 ELSE 0 END, n DESC, f) AS i FROM seen) SELECT ilon, ilat, event AS mode FROM k WHERE i = 1""")
def mode_nonzero(spark, d):
    return stats.mode_nonzero(views.grid_event(spark, d), "event", "time", ["ilon", "ilat"])


_WX = f"""{GRID}, {MASK}, b AS (SELECT CAST(YEAR(time) AS INT) AS year, cont, t2m AS x, {W} * lsm AS w FROM grid JOIN mask USING (ilon, ilat) WHERE {W} * lsm > 0),
    s AS (SELECT year, cont, COUNT(*) AS n, SUM(w) AS sw, SUM(w * w) AS sw2, SUM(w * x) / SUM(w) AS mean FROM b GROUP BY 1, 2),
    v AS (SELECT s.year, s.cont, ANY_VALUE(n) AS n, ANY_VALUE(sw) AS sw, ANY_VALUE(sw2) AS sw2, ANY_VALUE(mean) AS mean, SUM(w * (x - mean) * (x - mean)) / SUM(w) AS var
      FROM b JOIN s ON b.year = s.year AND b.cont IS NOT DISTINCT FROM s.cont GROUP BY 1, 2)"""


@query(f"""WITH {_WX} SELECT year, cont, n, {r('sw')} AS sum_w, {r('mean')} AS mean, {r('var')} AS var_uncorrected, {r('var / NULLIF(1 - sw2 / (sw * sw), 0)')} AS var_analytic,
    {r('var * sw / NULLIF(CASE WHEN sw > 1 THEN sw - 1 ELSE 0 END, 0)')} AS var_frequency FROM v WHERE cont IS NOT NULL""")
def weighted_mean_var(spark, d):
    rows = views.grid_daily(spark, d).join(views.mask(spark, d), ["ilon", "ilat"]).where(F.col("cont").isNotNull()).withColumn("year", F.year("time"))
    return stats.weighted_variance(rows, "t2m", area_weight(F.col("lat")) * F.col("lsm"), ["year", "cont"], near=273.15)


_STATES = _WX.replace("GROUP BY 1, 2)", "GROUP BY 1)").replace("CAST(YEAR(time) AS INT) AS year, cont", "cont").replace("SELECT year, cont, COUNT", "SELECT cont, COUNT").replace("SELECT s.year, s.cont", "SELECT s.cont").replace("b.year = s.year AND ", "")


@query(f"""WITH {_STATES} SELECT cont, n, {r('sw')} AS sum_w, {r('mean')} AS mean, {r('var')} AS var_uncorrected, {r('var / NULLIF(1 - sw2 / (sw * sw), 0)')} AS var_analytic,
    {r('var * sw / NULLIF(CASE WHEN sw > 1 THEN sw - 1 ELSE 0 END, 0)')} AS var_frequency FROM v WHERE cont IS NOT NULL""")
def state_table(spark, d):
    """Mean and variance of each continent over all years, merged from stored states; 1997 is computed a second time."""
    rows = views.grid_daily(spark, d).join(views.mask(spark, d), ["ilon", "ilat"]).where(F.col("cont").isNotNull()).withColumn("year", F.year("time"))
    ws = Workspace(spark, "state_table")
    rows = ws.save(rows.select("year", "cont", "lat", "lsm", "t2m"), "rows")
    kept = states.StateTable(spark, f"{ws.path}/store", {"t2m": states.moments(F.col("t2m"), area_weight(F.col("lat")) * F.col("lsm"), near=273.15)}, ["cont"])
    for some in ("year <= 1996", "year = 1997", "year >= 1998", "year = 1997"):
        kept.update(rows.where(some))
    return kept.merged(["cont"]).where("n > 0")  # a continent of cells without land share has states, but nothing in them


def _hist(by: str) -> str:
    return f"""WITH {EVENT}, {MASK}, b AS (SELECT CAST(YEAR(time) AS INT) AS year, CAST(MONTH(time) AS INT) AS month, lsm > 0.5 AS land, cont, event AS code, {W} * lsm AS w FROM event JOIN mask USING (ilon, ilat) WHERE cont IS NOT NULL),
      g AS (SELECT DISTINCT {by}, CAST(c AS INT) AS code FROM b, UNNEST(RANGE(17)) AS t(c))
      SELECT {by}, code, {r('COALESCE(SUM(w), 0)')} AS area FROM g LEFT JOIN b USING ({by}, code) GROUP BY {by}, code"""


def _coded(spark, d):
    rows = views.grid_event(spark, d).join(views.mask(spark, d), ["ilon", "ilat"]).where(F.col("cont").isNotNull())
    return rows.withColumns({"year": F.year("time"), "month": F.month("time"), "land": F.col("lsm") > 0.5}), area_weight(F.col("lat")) * F.col("lsm")


@query(_hist("year, cont"))
def weighted_hist_year_cont(spark, d):
    rows, w = _coded(spark, d)
    return stats.weighted_histogram(rows, "event", w, ["year", "cont"])


@query(_hist("year, month"))
def weighted_hist_month(spark, d):
    rows, w = _coded(spark, d)
    return stats.weighted_histogram(rows, "event", w, ["year", "month"])


@query(_hist("year, land"))
def weighted_hist_year_land(spark, d):
    rows, w = _coded(spark, d)
    return stats.weighted_histogram(rows, "event", w, ["year", "land"])


@query(f"WITH {GRID}, {MASK}, c AS (SELECT DISTINCT ilon, ilat, lat FROM grid) SELECT cont, {r(f'SUM({W} * lsm)')} AS area FROM c JOIN mask USING (ilon, ilat) WHERE cont IS NOT NULL GROUP BY cont")
def land_weight_cont(spark, d):
    cells = views.grid_daily(spark, d).select("ilon", "ilat", "lat").distinct().join(views.mask(spark, d), ["ilon", "ilat"]).where(F.col("cont").isNotNull())
    return cells.groupBy("cont").agg(F.sum(area_weight(F.col("lat")) * F.col("lsm")).alias("area"))


_EVENT_DAYS = f"""WITH {EVENT} SELECT ilon, ilat, CAST(YEAR(time) AS INT) AS year, kind, CAST(SUM(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS days
    FROM event, (VALUES ('h'), ('d30'), ('d90'), ('d180'), ('dh')) k(kind), LATERAL (SELECT CASE kind WHEN 'h' THEN (event & 1) <> 0 WHEN 'd30' THEN (event & 2) <> 0 WHEN 'd90' THEN (event & 4) <> 0
      WHEN 'd180' THEN (event & 8) <> 0 ELSE event > 1 AND event % 2 = 1 END AS hit) GROUP BY 1, 2, 3, 4"""


@query(_EVENT_DAYS)
def annual_event_days(spark, d):
    return stats.event_days(views.grid_event(spark, d).withColumn("year", F.year("time")))


_KINDS = {"h": lambda e: e & 1 > 0, "d30": lambda e: e & 2 > 0, "d90": lambda e: e & 4 > 0, "d180": lambda e: e & 8 > 0, "dh": lambda e: (e > 1) & (e % 2 == 1)}


def _count_days(cube):
    """Days of each kind in each year of a cell."""
    import numpy as np

    years, of = np.unique(cube["time"].astype("datetime64[Y]").astype(int) + 1970, return_inverse=True)
    code = cube["event"].astype(int)
    days = np.stack([np.bincount(of, weights=test(code), minlength=len(years)) for test in _KINDS.values()])
    return {"year": np.tile(years, len(_KINDS)), "kind": np.repeat(np.array(list(_KINDS), dtype=object), len(years)), "days": days.ravel().astype(int)}


@query(_EVENT_DAYS)
def kernel_event_days(spark, d):
    """The annual counts as a user's function with two output axes, years and kinds."""
    cube = kernels.Input(views.grid_event(spark, d).select("ilon", "ilat", "time", "event"), ("time",), ("event",))
    return kernels.map_cubes(_count_days, [cube], kernels.Output({"year": "integer", "kind": "string"}, {"days": "long"}, {"kind": list(_KINDS)}))


@query(f"""WITH {EVENT} SELECT CAST(YEAR(time) AS INT) AS year, COUNT(*) AS n, {r(_area('(event & 1) <> 0'))} AS heat, {r(_area('(event & 2) <> 0'))} AS drought30, {r(_area('(event & 4) <> 0'))} AS drought90,
    {r(_area('(event & 8) <> 0'))} AS drought180, {r(_area('event > 1 AND event % 2 = 1'))} AS compound, {r(f'SUM({W})')} AS volume FROM event WHERE event > 0 GROUP BY 1""")
def count_year(spark, d):
    w = area_weight(F.col("lat"))
    e = views.grid_event(spark, d).where("event > 0")
    return e.groupBy(F.year("time").alias("year")).agg(F.count("*").alias("n"), *stats.type_areas(F.col("event"), w), F.sum(w).alias("volume"))


@query(f"WITH {EVENT}, {MASK} SELECT lsm > 0.5 AS land, event AS code, {r(f'SUM(t2m * {W}) / SUM({W})')} AS t2m FROM event JOIN mask USING (ilon, ilat) GROUP BY 1, 2")
def weighted_mean_by_flag(spark, d):
    rows = views.grid_event(spark, d).join(views.mask(spark, d), ["ilon", "ilat"])
    return rows.groupBy((F.col("lsm") > 0.5).alias("land"), F.col("event").alias("code")).agg(wmean(F.col("t2m"), area_weight(F.col("lat"))).alias("t2m"))


@query(f"""WITH {EVENT}, {MASK} SELECT ilon, ilat, CAST(YEAR(time) AS INT) AS year, {r('SUM(CASE WHEN event = 1 THEN lsm ELSE 0 END)')} AS hot_days, {r('SUM(CASE WHEN event >= 1 AND event < 16 THEN lsm ELSE 0 END)')} AS extreme_days
    FROM event JOIN mask USING (ilon, ilat) GROUP BY 1, 2, 3""")
def code_days(spark, d):
    e, w = F.col("event"), F.col("lsm")
    rows = views.grid_event(spark, d).join(views.mask(spark, d), ["ilon", "ilat"])
    return rows.groupBy("ilon", "ilat", F.year("time").alias("year")).agg(F.sum(F.when(e == 1, w).otherwise(0.0)).alias("hot_days"), F.sum(F.when((e >= 1) & (e < 16), w).otherwise(0.0)).alias("extreme_days"))


@query(f"""WITH {EVENT} SELECT ilon, ilat, 'max' AS how, {r('MAX(t2mmax)')} AS value FROM event GROUP BY 1, 2 UNION ALL SELECT ilon, ilat, 'min', {r('MIN(t2mmax)')} FROM event GROUP BY 1, 2
    UNION ALL SELECT ilon, ilat, 'sum', {r('SUM(t2mmax)')} FROM event GROUP BY 1, 2 UNION ALL SELECT ilon, ilat, 'mean', {r('AVG(t2mmax)')} FROM event GROUP BY 1, 2
    UNION ALL SELECT ilon, ilat, 'first', {r('ARG_MIN(t2mmax, time)')} FROM event GROUP BY 1, 2""")
def collapse_axis(spark, d):
    return stats.collapse_all(views.grid_event(spark, d), "t2mmax", ["ilon", "ilat"], ["max", "min", "sum", "mean", "first"])


@query(f"""WITH {GRID} SELECT CAST(FLOOR(ROUND(t2m - 273.15, 6) / 2) AS BIGINT) AS bx, CAST(FLOOR(ROUND(tp * 1000, 6) / 0.5) AS BIGINT) AS by_, COUNT(*) AS n FROM grid GROUP BY 1, 2""")
def hist2d(spark, d):
    return stats.histogram_2d(views.grid_daily(spark, d), F.round(F.col("t2m") - 273.15, 6), F.round(F.col("tp") * 1000, 6), 2.0, 0.5)


_SERIES = f"""{YEARS}, pair AS (SELECT a.cell, a.year AS x1, CAST(a.y AS DOUBLE) AS y1, b.year AS x2, CAST(b.y AS DOUBLE) AS y2 FROM series a JOIN series b ON a.cell = b.cell AND a.year <> b.year),
    slope AS (SELECT cell, quantile_cont((y2 - y1) / (x2 - x1), 0.5) AS slope FROM pair GROUP BY cell),
    rest AS (SELECT s.cell, year, y - slope * year AS rest, slope, COUNT(*) OVER (PARTITION BY s.cell) AS n, ROW_NUMBER() OVER (PARTITION BY s.cell ORDER BY y - slope * year, year) AS i FROM series s JOIN slope USING (cell))"""


def _years(spark, d):
    line, supp = views.table(spark, d, "lineitem"), views.table(spark, d, "supplier")
    return line.join(supp, line.l_suppkey == supp.s_suppkey).groupBy(F.col("s_nationkey").cast("int").alias("cell"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("y"))


@query(f"""WITH {_SERIES} SELECT cell, {r('ANY_VALUE(slope)')} AS slope, {r('AVG(rest)')} AS intercept FROM rest
    WHERE i = FLOOR(n / 2) OR (n % 2 = 0 AND i = LEAST(FLOOR(n / 2) + 2, n)) GROUP BY cell""")
def theil_sen(spark, d):
    return trends.theil_sen(_years(spark, d), "year", "y", ["cell"])


# the tails of the normal distribution by Simpson's rule on its density, independent of the operator's series and fractions
_TAILS = """tails AS (SELECT cell, 1 - 2 * SUM(CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * EXP(-(z * k / 2000) * (z * k / 2000) / 2)) * MAX(ABS(z)) / 6000 / SQRT(2 * PI()) AS p
    FROM z, UNNEST(RANGE(2001)) AS u(k) GROUP BY cell)"""


@query(f"""WITH {_SERIES}, s AS (SELECT cell, SUM(SIGN(y2 - y1)) AS s FROM pair WHERE x1 < x2 GROUP BY cell), n AS (SELECT cell, COUNT(*) AS n FROM series GROUP BY cell),
    z AS (SELECT cell, s, n, CASE WHEN s >= 0 THEN s - 1 ELSE s + 1 END / SQRT(n * (n - 1) * (2 * n + 5) / 18.0) AS z FROM s JOIN n USING (cell)), {_TAILS},
    i AS (SELECT cell, ANY_VALUE(slope) AS slope, quantile_cont(rest, 0.5) AS intercept FROM rest GROUP BY cell)
    SELECT cell, n, CAST(s AS DOUBLE) AS s, {r('z')} AS z, {r('p')} AS p_value, {r('s / (0.5 * n * (n - 1))')} AS tau, ABS(z) > 1.959963984540054 AS reject, {r('slope')} AS slope, {r('intercept')} AS intercept
    FROM z JOIN tails USING (cell) JOIN i USING (cell)""")
def mann_kendall(spark, d):
    return trends.mann_kendall(_years(spark, d), "year", "y", ["cell"])


@query(f"WITH {YEARS} SELECT cell, {r('REGR_SLOPE(y, year)')} AS slope, round_even(REGR_INTERCEPT(y, year) * 1e4, 0) / 1e4 AS intercept FROM series GROUP BY cell")
def ols_trend(spark, d):
    return trends.ols_trend(_years(spark, d), "year", "y", ["cell"]).withColumn("intercept", F.rint(F.col("intercept") * 1e4) / 1e4)


@query()
def quantile_regression(spark, d):
    """Lines of log10 volume against year over the monthly points of each continent; held against the loss itself in the tests."""
    rows = views.grid_daily(spark, d).join(views.mask(spark, d), ["ilon", "ilat"]).where(F.col("cont").isNotNull())
    points = rows.groupBy("cont", F.year("time").cast("double").alias("year"), "ilon", "ilat", F.month("time").alias("month")).agg(F.log10(F.sum("tp") * 1e3).alias("v"))
    return trends.quantile_regression(points, "year", "v", ["cont"], [0.1, 0.5, 0.9])


@query(f"""WITH {GRID}, {MASK}, p AS (SELECT cont, CAST(YEAR(time) AS DOUBLE) AS x, ilon, ilat, LOG10(SUM(tp) * 1e3) AS y FROM grid JOIN mask USING (ilon, ilat) WHERE cont IS NOT NULL GROUP BY 1, 2, 3, 4),
    lines AS (SELECT a.cont, a.x * 100 + a.ilon * 10 + a.ilat AS i, b.x * 100 + b.ilon * 10 + b.ilat AS j, (b.y - a.y) / (b.x - a.x) AS slope, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS icept FROM p a JOIN p b ON a.cont = b.cont AND a.x < b.x),
    rest AS (SELECT l.cont, i, j, quantile, p.y - slope * p.x - icept AS r FROM lines l JOIN p ON l.cont = p.cont, (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) q(quantile)),
    loss AS (SELECT cont, quantile, i, j, SUM(CASE WHEN r >= 0 THEN quantile * r ELSE (quantile - 1) * r END) AS loss FROM rest GROUP BY 1, 2, 3, 4)
    SELECT cont, quantile, {r('MIN(loss)')} AS loss FROM loss GROUP BY 1, 2""")
def quantile_regression_loss(spark, d):
    """Loss of the lines of log10 rain against year through the cells of each continent; the SQL tries every line through two points."""
    rows = views.grid_daily(spark, d).join(views.mask(spark, d), ["ilon", "ilat"]).where(F.col("cont").isNotNull())
    points = rows.groupBy("cont", F.year("time").cast("double").alias("x"), "ilon", "ilat").agg(F.log10(F.sum("tp") * 1e3).alias("y"))
    return trends.pinball_loss(points, trends.quantile_regression(points, "x", "y", ["cont"], [0.1, 0.5, 0.9]), "x", "y", ["cont"])


@query(f"""WITH {GRID}, old AS (SELECT 'old' AS version, CAST(YEAR(time) AS INT) AS year, t2mmax AS v FROM grid WHERE YEAR(time) < 1998), new AS (SELECT 'common', CAST(YEAR(time) AS INT), t2m FROM grid WHERE YEAR(time) >= 1998),
    u AS (SELECT * FROM old UNION ALL SELECT * FROM new), y AS (SELECT version, year, AVG(v) AS v FROM u GROUP BY 1, 2)
    SELECT version, COUNT(*) AS years, {r('REGR_SLOPE(v, year)')} AS slope FROM y GROUP BY version""")
def blended_trend(spark, d):
    g = views.grid_daily(spark, d).withColumn("year", F.year("time"))
    old = g.where("year < 1998").select(F.lit("old").alias("version"), "year", F.col("t2mmax").alias("v"))
    new = g.where("year >= 1998").select(F.lit("common").alias("version"), "year", F.col("t2m").alias("v"))
    y = old.unionByName(new).groupBy("version", "year").agg(F.avg("v").alias("v"))
    return y.groupBy("version").agg(F.count("*").alias("years"), F.regr_slope("v", "year").alias("slope"))
