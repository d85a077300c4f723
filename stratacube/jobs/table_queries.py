"""Queries on sources, checks, tables, sorting, pivoting, and the streaming twin of the daily aggregate."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratacube.functions.columns import area_weight
from stratacube.jobs.declare import registrar
from stratacube.jobs.event_queries import labels
from stratacube.jobs.sql import EVENT, GRID, HOURLY, REF, components as components_sql, r
from stratacube.operators import events
from stratacube.operators.windows import share_of_total as with_share
from stratacube.sources import checks, chunked, readers, views, writers
from stratacube.sources.workspace import Workspace
from stratacube.streaming.daily import daily_from_stream

QUERIES: dict = {}
ORACLE_SQL: dict = {}
query = registrar(QUERIES, ORACLE_SQL)

W = "COS(RADIANS(lat))"


@query(f"SELECT event_id, {r('CASE WHEN CAST(ROUND(value * 100) AS BIGINT) = 0 THEN NULL ELSE CAST(ROUND(value * 100) AS BIGINT) * 0.01 + 273.15 END')} AS t2m FROM events")
def scale_offset_decode(spark, d):
    packed = views.table(spark, d, "events").select("event_id", F.round(F.col("value") * 100).cast("long").alias("packed"))
    return packed.select("event_id", readers.decode(F.col("packed"), 0.01, 273.15, 0).alias("t2m"))


@query("""SELECT date_trunc('month', ts)::DATE AS month, COUNT(DISTINCT date_trunc('hour', ts)) AS steps, CAST(DAY(LAST_DAY(MIN(ts)::DATE)) * 24 AS BIGINT) AS expected,
    COUNT(DISTINCT date_trunc('hour', ts)) = DAY(LAST_DAY(MIN(ts)::DATE)) * 24 AS complete FROM events GROUP BY 1""")
def shape_check(spark, d):
    return checks.month_steps(views.table(spark, d, "events"), "ts")


@query(f"""WITH {GRID}, have AS (SELECT ilon, ilat, YEAR(time) AS year, COUNT(DISTINCT MONTH(time)) AS months FROM grid GROUP BY 1, 2, 3), cells AS (SELECT DISTINCT ilon, ilat FROM grid),
    want AS (SELECT ilon, ilat, y AS year FROM cells, UNNEST(RANGE(1995, 2002)) AS t(y))
    SELECT w.ilon, w.ilat, CAST(w.year AS INT) AS year, CAST(COALESCE(months, 0) AS BIGINT) AS months FROM want w LEFT JOIN have h ON w.ilon = h.ilon AND w.ilat = h.ilat AND w.year = h.year WHERE COALESCE(months, 0) < 12""")
def calendar_gaps(spark, d):
    return checks.missing_months(views.grid_daily(spark, d), ["ilon", "ilat"], 1995, 2001)


@query(f"""WITH {GRID}, m AS (SELECT date_trunc('month', time)::DATE AS month, COUNT(DISTINCT time) AS steps, COUNT(DISTINCT ilon) AS lons, COUNT(DISTINCT ilat) AS lats FROM grid GROUP BY 1)
    SELECT month, steps, lons, lats, steps = DAY(LAST_DAY(month)) AND lons = 5 AND lats = 5 AS complete FROM m""")
def grid_shape_check(spark, d):
    return checks.grid_shape(views.grid_daily(spark, d), views.NLON, views.NLAT)


@query("""WITH m AS (SELECT DISTINCT strftime(l_shipdate, '%m.%Y') AS tail FROM lineitem), f AS (SELECT 't2m.hh.' || tail || '.parquet' AS path, tail FROM m UNION ALL SELECT 't2m.hh.back_extension.' || tail || '.parquet', tail FROM m
      UNION ALL SELECT 't2m.dd.' || tail || '.parquet', tail FROM m WHERE tail LIKE '02.%')
    SELECT CAST(substring(tail, 4, 4) AS INT) AS year, CAST(substring(tail, 1, 2) AS INT) AS month, MIN(path) AS path, COUNT(*) AS files, COUNT(*) = 1 AS "unique" FROM f WHERE path NOT LIKE '%back_extension%' GROUP BY 1, 2""")
def month_files(spark, d):
    """The file of each month among the names of a store that also holds backward extensions, and February files of another step."""
    tail = views.table(spark, d, "lineitem").select(F.date_format("l_shipdate", "MM.yyyy").alias("tail")).distinct()
    name = lambda kind: F.concat(F.lit(kind), "tail", F.lit(".parquet")).alias("path")
    names = tail.select(name("t2m.hh.")).union(tail.select(name("t2m.hh.back_extension."))).union(tail.where("tail LIKE '02.%'").select(name("t2m.dd.")))
    return readers.one_file_per_month(names)


@query(f"WITH {REF} SELECT obs_event, start_ AS start, end_ AS \"end\", {r('west')} AS west, {r('north')} AS north FROM ref")
def event_list_csv(spark, d):
    """The list of documented events written as text with two lines before its header and dates like 2003.08.01, and read back."""
    from stratacube.sources.workspace import Workspace

    ws = Workspace(spark, "lists")
    day = lambda c: F.date_format(c, "yyyy.MM.dd")
    line = views.ref_events(spark, d).select(F.concat_ws(",", "obs_event", day("start"), day("end"), F.col("west").cast("string"), F.col("north").cast("string")).alias("value"))
    head = F.array(F.lit("documented events"), F.lit("one row per nation"), F.lit("obs_event,start,end,west,north"))
    whole = line.agg(F.concat_ws("\n", F.concat(head, F.array_sort(F.collect_list("value")))).alias("value"))  # one short file of one row per nation
    whole.write.mode("overwrite").text(f"{ws.path}/events")
    return readers.read_event_list(spark, f"{ws.path}/events", "obs_event int, start date, end date, west double, north double", preamble=2)


@query(f"WITH {GRID} SELECT ilon, ilat, time, {r('t2m')} AS t2m, {r('CASE WHEN YEAR(time) = 1998 THEN tp * 1e3 + 1 ELSE tp * 1e3 END')} AS rain FROM grid")
def layer_and_year_update(spark, d):
    """A layer joined to a stored cube, then one year of the store overwritten."""
    from stratacube.sources import writers
    from stratacube.sources.workspace import Workspace

    ws = Workspace(spark, "layers")
    cube = views.grid_daily(spark, d)
    writers.write_cube(cube.select("ilon", "ilat", "time", "t2m"), f"{ws.path}/cube")
    writers.add_layer(spark, cube.select("ilon", "ilat", "time", (F.col("tp") * 1e3).alias("rain")), f"{ws.path}/cube", f"{ws.path}/wide")
    wide = readers.read_cube(spark, f"{ws.path}/wide").drop("year")
    writers.replace_years(wide.where("year(time) = 1998").withColumn("rain", F.col("rain") + 1).transform(ws.save, "fresh"), f"{ws.path}/wide")
    return readers.read_cube(spark, f"{ws.path}/wide").select("ilon", "ilat", "time", "t2m", "rain")


@query(f"WITH {GRID} SELECT ilon, ilat, time, {r('t2m')} AS t2m FROM grid")
def multi_part_scan(spark, d):
    """The cube written by year with time appended in two goes, and read back as one."""
    from stratacube.sources import writers
    from stratacube.sources.workspace import Workspace

    ws = Workspace(spark, "parts")
    cube = views.grid_daily(spark, d).select("ilon", "ilat", "time", "t2m")
    path = f"{ws.path}/cube"
    writers.write_cube(cube.where("year(time) < 1999"), path)
    writers.append_days(spark, cube, path)
    return readers.read_cube(spark, path).select("ilon", "ilat", "time", "t2m")


@query(f"WITH {GRID} SELECT CAST(YEAR(time) AS INT) AS year, COUNT(*) AS n, {r('SUM(t2m)')} AS warmth FROM grid WHERE ilat >= 2 GROUP BY 1")
def several_folders_scan(spark, d):
    """A cube that lies in two folders, its earlier and its later years, read as one; the latitudes are chosen in the scan."""
    from stratacube.sources import writers
    from stratacube.sources.workspace import Workspace

    ws = Workspace(spark, "folders")
    cube = views.grid_daily(spark, d).select("ilon", "ilat", "time", "t2m")
    late = F.year("time") >= 1996
    paths = [f"{ws.path}/{name}" for name in ("early", "late")]
    for path, part in zip(paths, (cube.where(~late), cube.where(late)), strict=True):
        writers.write_cube(part, path)
    both = readers.read_cube(spark, *paths, columns=["ilat", "time", "t2m"]).where("ilat >= 2")
    return both.groupBy(F.year("time").alias("year")).agg(F.count("*").alias("n"), F.sum("t2m").alias("warmth"))


@query(f"""WITH {EVENT} SELECT CAST(YEAR(time) AS INT) AS year, {r(f'SUM(CASE WHEN (event & 1) <> 0 THEN {W} ELSE 0 END)')} AS heat,
    {r(f'SUM(CASE WHEN (event & 1) <> 0 THEN {W} ELSE 0 END) * 100 / SUM(SUM(CASE WHEN (event & 1) <> 0 THEN {W} ELSE 0 END)) OVER ()')} AS share FROM event GROUP BY 1""")
def share_of_total(spark, d):
    w = area_weight(F.col("lat"))
    y = views.grid_event(spark, d).groupBy(F.year("time").alias("year")).agg(F.sum(F.when(F.col("event").bitwiseAND(1) != 0, w).otherwise(0.0)).alias("heat"))
    return with_share(y.withColumn("all", F.lit(1)), "heat", "share", ["all"]).drop("all")


_SIZE = f"size AS (SELECT label, SUM(round_even({W} * 1e9, 0)) / 1e9 AS volume, MAX(time) - MIN(time) + 1 AS duration, MIN(time) AS start_time FROM voxel GROUP BY label)"


def _sizes(spark, d):
    w = F.rint(area_weight(F.col("lat")) * 1e9)
    return labels(spark, d).groupBy("label").agg((F.sum(w) / 1e9).alias("volume"), (F.datediff(F.max("time"), F.min("time")) + 1).alias("duration"), F.min("time").alias("start_time"))


@query(f"WITH RECURSIVE {components_sql(True)}, {_SIZE} SELECT label, {r('volume')} AS volume, CAST(duration AS INT) AS duration FROM size ORDER BY volume DESC, label LIMIT 10")
def topk_volume(spark, d):
    return _sizes(spark, d).orderBy(F.desc("volume"), "label").limit(10).select("label", "volume", "duration")


@query(f"""WITH RECURSIVE {components_sql(True)}, {_SIZE}, k AS (SELECT CAST(YEAR(start_time) AS INT) AS year, label, volume, ROW_NUMBER() OVER (PARTITION BY YEAR(start_time) ORDER BY volume DESC, label) AS k FROM size)
    SELECT year, label, {r('volume')} AS volume, CAST(k AS INT) AS k FROM k WHERE k <= 20""")
def topk_per_type(spark, d):
    y = _sizes(spark, d).withColumn("year", F.year("start_time"))
    return y.withColumn("k", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("volume"), "label"))).where("k <= 20").select("year", "label", "volume", "k")


@query(f"""WITH {EVENT}, m AS (SELECT CAST(YEAR(time) AS INT) AS year, CASE WHEN event = 1 THEN 'hot' WHEN event % 2 = 0 THEN 'dry' ELSE 'hot+dry' END AS kind, COUNT(*) AS days FROM event WHERE event > 0 AND event < 16 GROUP BY 1, 2)
    SELECT kind, {r('AVG(CASE WHEN year < 1998 THEN days END)')} AS early, {r('AVG(CASE WHEN year >= 1998 THEN days END)')} AS late FROM m GROUP BY kind""")
def pivot_periods(spark, d):
    e = views.grid_event(spark, d).where(events.is_extreme(F.col("event")))
    m = e.groupBy(F.year("time").alias("year"), events.macro_type(F.col("event")).alias("kind")).agg(F.count("*").alias("days"))
    return m.withColumn("period", F.when(F.col("year") < 1998, "early").otherwise("late")).groupBy("kind").pivot("period", ["early", "late"]).agg(F.avg("days"))


@query(f"""WITH {GRID}, m AS (SELECT ilon, ilat, AVG(t2m) AS t2m, AVG(tp) AS tp, AVG(pet) AS pet FROM grid GROUP BY 1, 2)
    SELECT ilon, ilat, 't2m' AS variable, {r('t2m')} AS value FROM m UNION ALL SELECT ilon, ilat, 'tp', {r('tp')} FROM m UNION ALL SELECT ilon, ilat, 'pet', {r('pet')} FROM m""")
def unpivot(spark, d):
    m = views.grid_daily(spark, d).groupBy("ilon", "ilat").agg(*(F.avg(c).alias(c) for c in ("t2m", "tp", "pet")))
    return m.unpivot(["ilon", "ilat"], ["t2m", "tp", "pet"], "variable", "value")


@query(f"WITH {GRID} SELECT DISTINCT ilon, ilat FROM grid WHERE tp > 0.01 UNION SELECT DISTINCT ilon, ilat FROM grid WHERE t2m > 300")
def union_distinct(spark, d):
    g = views.grid_daily(spark, d)
    return g.where("tp > 0.01").select("ilon", "ilat").unionByName(g.where("t2m > 300").select("ilon", "ilat")).distinct()


@query(f"""WITH {GRID}, t AS (SELECT ilon, ilat, time, CASE WHEN n_obs > 1 THEN t2m END AS t FROM grid) SELECT ilon, ilat, time, {r('t - 273.15')} AS celsius FROM t WHERE t IS NOT NULL""")
def drop_missing(spark, d):
    """Days of too few observations are missing and dropped; the others converted from K."""
    g = views.grid_daily(spark, d).select("ilon", "ilat", "time", F.when(F.col("n_obs") > 1, F.col("t2m")).alias("t"))
    return g.na.drop().select("ilon", "ilat", "time", (F.col("t") - 273.15).alias("celsius"))


@query(f"""WITH RECURSIVE {components_sql(True)}, long AS (SELECT label FROM voxel GROUP BY label HAVING MAX(time) - MIN(time) >= 9)
    SELECT ilon, ilat, time, CASE WHEN label IN (SELECT label FROM long) THEN label ELSE 0 END AS label FROM voxel""")
def sublabels(spark, d):
    """Labels of events of ten days and more; all others become 0."""
    v = labels(spark, d)
    long = v.groupBy("label").agg(F.datediff(F.max("time"), F.min("time")).alias("days")).where("days >= 9").select("label", F.lit(1).alias("hit"))
    return v.join(long, "label", "left").select("ilon", "ilat", "time", F.when(F.col("hit") == 1, F.col("label")).otherwise(0).alias("label"))


_NAMES = "(VALUES (1, 'Africa'), (2, 'Asia'), (3, 'Australia'), (4, 'North America'), (5, 'Oceania'), (6, 'South America'), (7, 'Antarctica'), (8, 'Europe')) n(cont, name)"
# Continent numbers and names.
CONTINENTS = {1: "Africa", 2: "Asia", 3: "Australia", 4: "North America", 5: "Oceania", 6: "South America", 7: "Antarctica", 8: "Europe"}


@query(f"SELECT c_custkey, name AS continent FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN {_NAMES} ON n_regionkey + 1 = cont AND n_nationkey <> 24")
def continent_names(spark, d):
    m = views.table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") != 24, F.col("n_regionkey") + 1).alias("cont"))
    names = F.create_map(*(F.lit(x) for pair in CONTINENTS.items() for x in pair))
    customers = views.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return customers.join(m, "n_nationkey").select("c_custkey", names[F.col("cont").cast("int")].alias("continent"))


@query("""SELECT c_custkey, replace(c_name, '#', '-') AS name, concat_ws('.', CAST(n_regionkey AS VARCHAR), n_name, c_name) AS key, upper(substring(c_mktsegment, 1, 3)) AS short FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def string_keys(spark, d):
    n = views.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey", "n_name")
    c = views.table(spark, d, "customer").join(n, "c_nationkey")
    return c.select("c_custkey", F.regexp_replace("c_name", "#", "-").alias("name"), F.concat_ws(".", F.col("n_regionkey").cast("string"), "n_name", "c_name").alias("key"), F.upper(F.substring("c_mktsegment", 1, 3)).alias("short"))


@query(f"""WITH {HOURLY} SELECT ilon, ilat, CAST(ts AS DATE) AS time, {r('SUM(tp)')} AS tp, CAST(SUM(n) AS BIGINT) AS n FROM hourly GROUP BY ilon, ilat, CAST(ts AS DATE)""")
def stream_daily(spark, d):
    """Events as a stream, summed by cell and day under a watermark, written as they close."""
    return daily_from_stream(spark, f"{d}/events.parquet")


@query(f"""WITH {GRID} SELECT ilon, ilat, time, {r('t2mmax')} AS t2mmax, {r('tp')} AS tp FROM grid WHERE ilon >= 1 AND ilat <= 2 AND time >= DATE '1995-06-01' AND time < DATE '1997-03-15'""")
def chunked_store_box(spark, d):
    """A box of the grid from a chunked array store; only the chunks that meet it are opened."""
    ws = Workspace(spark, "chunked_store")
    grid = ws.save(views.grid_daily(spark, d).select("ilon", "ilat", "time", "t2mmax", "tp"), "grid")
    days = grid.select(F.explode(F.sequence(F.min("time"), F.max("time")))).collect()  # one side of the cube
    sides = {"ilon": list(range(views.NLON)), "ilat": list(range(views.NLAT)), "time": [r[0] for r in days]}
    chunked.create_store(f"{ws.path}/store", sides, {"t2mmax": "<f8", "tp": "<f8"}, {"ilon": 2, "ilat": 2, "time": 365}, {"id": "zlib", "level": 1})
    chunked.write_store(grid, f"{ws.path}/store")
    box = (F.col("ilon") >= 1) & (F.col("ilat") <= 2) & (F.col("time") >= F.lit("1995-06-01").cast("date")) & (F.col("time") < F.lit("1997-03-15").cast("date"))
    got = chunked.read_store(spark, f"{ws.path}/store", "t2mmax", "tp").where(box)
    return got.select(F.col("ilon").cast("int").alias("ilon"), F.col("ilat").cast("int").alias("ilat"), "time", "t2mmax", "tp")


@query(f"""WITH {EVENT} SELECT CAST(YEAR(time) AS INT) AS year, event, COUNT(*) AS days, {r('AVG(t2mmax)')} AS t2mmax FROM event GROUP BY 1, 2""")
def csv_report(spark, d):
    """Days and mean heat of each code and year, written as CSV and read back."""
    ws = Workspace(spark, "csv_report")
    writers.write_csv(views.grid_event(spark, d).groupBy(F.year("time").alias("year"), "event").agg(F.count("*").alias("days"), F.avg("t2mmax").alias("t2mmax")), f"{ws.path}/report")
    return readers.read_event_list(spark, f"{ws.path}/report", "year int, event int, days bigint, t2mmax double")


@query(f"""WITH {GRID}, m AS (SELECT * FROM (VALUES ('t2mmax', 'K', 'largest temperature of the day'), ('tp', 'm', 'rain')) v(layer, units, long_name)), n AS (SELECT COUNT(t2mmax) AS a, COUNT(tp) AS b FROM grid)
    SELECT layer, units, long_name, CASE layer WHEN 'tp' THEN b ELSE a END AS n FROM m, n""")
def layer_metadata(spark, d):
    """Properties of layers as they come back from a stored cube, with the number of values."""
    ws = Workspace(spark, "layer_metadata")
    named = views.grid_daily(spark, d).select("ilon", "ilat", "time", "t2mmax", "tp")
    named = writers.with_metadata(named, "t2mmax", units="K", long_name="largest temperature of the day")
    writers.write_cube(writers.with_metadata(named, "tp", units="m", long_name="rain"), f"{ws.path}/cube")
    cube = readers.read_cube(spark, f"{ws.path}/cube")
    layers = [f for f in cube.schema if "units" in f.metadata]
    counts = cube.agg(*(F.count(f.name).alias(f.name) for f in layers)).unpivot([], [f.name for f in layers], "layer", "n")
    told = F.create_map(*(x for f in layers for x in (F.lit(f.name), F.struct(F.lit(f.metadata["units"]).alias("units"), F.lit(f.metadata["long_name"]).alias("long_name")))))
    return counts.select("layer", told[F.col("layer")]["units"].alias("units"), told[F.col("layer")]["long_name"].alias("long_name"), "n")
