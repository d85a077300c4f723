"""Boxes, points, longitudes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box(cube: DataFrame, lon: tuple[float, float] | None = None, lat: tuple[float, float] | None = None, time: tuple[str, str] | None = None) -> DataFrame:
    """Closed ranges along each axis; all three can be pruned at the scan."""
    out = cube.where(F.col("lon").between(*sorted(lon))) if lon else cube
    out = out.where(F.col("lat").between(*sorted(lat))) if lat else out
    return out.where(F.col("time").between(*(F.lit(t).cast("date") for t in time))) if time else out


def lon_ranges(west: float, east: float) -> list[tuple[float, float]]:
    """0..360 ranges of a box given in -180..180: both ends west of 0 move by 360, a box across 0 splits in two."""
    if west < 0 and east < 0:
        return [(west + 360, east + 360)]
    if west < 0 <= east:
        return [(west + 360, 360.0), (0.0, east)]
    return [(west, east)]


def split_boxes(boxes: DataFrame) -> DataFrame:
    """The same rule for a table of boxes (west, east): one or two rows each, with lon_from and lon_to."""
    both = (F.col("west") < 0) & (F.col("east") < 0)
    across = (F.col("west") < 0) & (F.col("east") >= 0)
    pair = lambda a, b: F.struct(a.cast("double").alias("f"), b.cast("double").alias("t"))
    parts = F.when(both, F.array(pair(F.col("west") + 360, F.col("east") + 360))).when(across, F.array(pair(F.col("west") + 360, F.lit(360.0)), pair(F.lit(0.0), F.col("east")))).otherwise(F.array(pair(F.col("west"), F.col("east"))))
    return boxes.withColumn("p", F.explode(parts)).withColumns({"lon_from": F.col("p.f"), "lon_to": F.col("p.t")}).drop("p")


def shift_longitude(lon: Column) -> Column:
    """0..360 to -180..180."""
    return F.when(lon > 180, lon - 360).otherwise(lon)


def expand_low(x: Column) -> Column:
    return F.floor((x - 1) / 5) * 5


def expand_high(x: Column) -> Column:
    return F.ceil((x + 1) / 5) * 5


def nearest_cell(cells: DataFrame, points: DataFrame, tolerance: float, name: str = "name") -> DataFrame:
    """The nearest cell within ``tolerance`` degrees on both axes for each point (name, plon, plat).

    Cells are listed by bins of the tolerance, and each list is handed to the nine bins around it.  Points are neither
    multiplied nor broadcast: they stream past the lists of their bin, and each list gives them one cell at most.
    """
    bins = lambda c: F.floor(c / tolerance).cast("long")
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    lists = cells.groupBy(bins(F.col("lon")).alias("cx"), bins(F.col("lat")).alias("cy")).agg(F.collect_list(F.struct(*cells.columns)).alias("listed"))
    lists = lists.select("listed", "cy", around("cx").alias("bx")).select("listed", "bx", around("cy").alias("by_"))
    placed = points.select("*", bins(F.col("plon")).alias("bx"), bins(F.col("plat")).alias("by_"))
    inside = lambda c: (F.abs(c["lon"] - F.col("plon")) <= tolerance) & (F.abs(c["lat"] - F.col("plat")) <= tolerance)
    d = lambda c: F.pow(c["lon"] - F.col("plon"), 2) + F.pow(c["lat"] - F.col("plat"), 2)
    ranked = F.transform(F.filter("listed", inside), lambda c: F.struct(d(c).alias("d"), c["ilon"].alias("i"), c["ilat"].alias("j"), c.alias("cell")))
    hit = placed.join(lists.hint("shuffle_hash"), ["bx", "by_"]).select(*points.columns, F.array_min(ranked).alias("hit")).where("hit IS NOT NULL")
    first = F.row_number().over(Window.partitionBy(name).orderBy("hit.d", "hit.i", "hit.j"))
    return hit.withColumn("r", first).where("r = 1").select(*points.columns, "hit.cell.*")


def month_of(day: Column) -> Column:
    """Months since year 0, an integer key for joins of periods."""
    return F.year(day) * 12 + F.month(day)


def each_month(periods: DataFrame, start: str, end: str, out: str = "month") -> DataFrame:
    """Every period once for each month that it touches."""
    return periods.where(F.col(start) <= F.col(end)).withColumn(out, F.explode(F.sequence(month_of(F.col(start)), month_of(F.col(end)))))


def in_boxes(cube: DataFrame, boxes: DataFrame, time: str = "time") -> DataFrame:
    """Rows of the cube inside boxes (start, end, south, north, lon_from, lon_to), once for each box.

    Rows and boxes meet in the month of the row, so the join has an equality and neither side need be small.
    """
    inside = F.col(time).between(F.col("start"), F.col("end")) & F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("lon_from"), F.col("lon_to"))
    return cube.withColumn("month", month_of(F.col(time))).join(each_month(boxes, "start", "end"), "month").where(inside).drop("month")


def overlapping(one: DataFrame, two: DataFrame) -> DataFrame:
    """Pairs of periods (a0, a1) and (b0, b1) that share a day, met in the month in which the later one begins."""
    met = each_month(one, "a0", "a1").join(each_month(two, "b0", "b1"), "month")
    return met.where((F.col("month") == month_of(F.greatest("a0", "b0"))) & F.expr("a0 <= b1 AND b0 <= a1")).drop("month")


def index_in(rows: DataFrame, listed: DataFrame, column: str, out: str) -> DataFrame:
    """``rows`` with the index i that (column, i) lists for each value of ``column``; null for those it does not list."""
    return rows.join(listed.select(column, F.col("i").cast("double").alias(out)), column, "left")
