"""Space-time connected components of a mask, on the graph of its runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratacube.operators.graph import connected_components
from stratacube.operators.subset import each_month, month_of
from stratacube.operators.windows import runs
from stratacube.sources.workspace import Workspace


def run_graph(days: DataFrame, nlon: int, nlat: int, wrap: bool, epoch: str, value: str | None = None, ws: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """(runs with id, edges): a run of days in a cell is a node; runs of neighbouring cells that share a day are linked.

    A run's id is its first voxel's place in scan order (longitude fastest, then latitude, then day).  With ``ws`` the
    runs are a written table, so that what ``days`` are made from is not computed for the links again.
    """
    key = ("ilon", "ilat", *([value] if value else []))
    day = lambda c: F.datediff(F.col(c), F.lit(epoch).cast("date")).cast("long")
    r = runs(days, cell=key).withColumn("id", (day("t0") * nlat + F.col("ilat")) * nlon + F.col("ilon"))
    r = ws.save(r, "runs") if ws else r
    east = F.pmod(F.col("ilon") + 1, F.lit(nlon)) if wrap else F.col("ilon") + 1
    # runs that share a day share its month: they meet there, and only in the month in which the later one begins
    by_month = each_month(r, "t0", "t1")
    sides = by_month.select(F.explode(F.array(F.struct(east.cast("int").alias("x"), F.col("ilat").cast("int").alias("y")), F.struct(F.col("ilon").cast("int").alias("x"), (F.col("ilat") + 1).cast("int").alias("y")))).alias("s"), "month", "id", "t0", "t1", *([value] if value else []))
    a = sides.select(F.col("s.x").alias("ilon"), F.col("s.y").alias("ilat"), "month", F.col("id").alias("src"), F.col("t0").alias("a0"), F.col("t1").alias("a1"), *([value] if value else []))
    met = a.join(by_month.select(*key, "month", F.col("id").alias("dst"), "t0", "t1"), [*key, "month"])
    edges = met.where((F.col("month") == month_of(F.greatest("a0", "t0"))) & F.expr("a0 <= t1 AND t0 <= a1 AND src <> dst")).select("src", "dst")
    return r, edges


def label_components(days: DataFrame, nlon: int, nlat: int, wrap: bool = True, epoch: str = "1970-01-01", value: str | None = None) -> DataFrame:
    """``days`` (ilon, ilat, time, ...) with label 1..n in scan order of each component's first voxel.

    Voxels are neighbours when they share a face; with ``wrap`` the last longitude is next to the first.  With
    ``value`` only voxels of equal value connect.  Labels, not voxels, pass through the final numbering, which
    ranges over sorted component ids.
    """
    ws = Workspace(days.sparkSession, "labels")
    days = ws.save(days, "days")
    r, edges = run_graph(days, nlon, nlat, wrap, epoch, value, ws)
    comp = connected_components(edges)
    named = ws.save(r.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id")), "named")
    numbers = number_in_order(named.select("component").distinct(), "component", "label", ws)
    labelled = named.join(numbers, "component").select("ilon", "ilat", "t0", "t1", "label", *([value] if value else []))
    spread = labelled.select("ilon", "ilat", "label", F.explode(F.sequence("t0", "t1")).alias("time"), *([value] if value else []))
    return days.join(spread, ["ilon", "ilat", "time", *([value] if value else [])])


def number_in_order(rows: DataFrame, column: str, out: str, ws: Workspace) -> DataFrame:
    """1..n along ``column``: sorted ranges are counted, then numbered each by itself, so no task sees all rows."""
    ranged = ws.save(rows.repartitionByRange(column).sortWithinPartitions(column).withColumn("__part", F.spark_partition_id()), f"order_{out}")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each partition
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(column))
    return ranged.withColumn("__r", within).join(F.broadcast(before), "__part").select(column, (F.col("__before") + F.col("__r")).alias(out))


def label_by_tiles(days: DataFrame, tile: str, nlon: int, nlat: int, epoch: str = "1970-01-01") -> DataFrame:
    """Label each time tile by itself, then join labels across the seams; the result equals labelling all at once.

    ``tile`` is an ordered integer column; tiles follow each other in time.  Inside a tile longitude wraps; across a
    seam a cell true on the last day of one tile and the first day of the next joins their labels, which is all
    that face neighbours of different days can do.
    """
    ws = Workspace(days.sparkSession, "tiles")
    days = ws.save(days, "days")
    r, edges = run_graph(days, nlon, nlat, True, epoch, tile, ws)
    inner = connected_components(edges)
    local = ws.save(r.join(inner, "id", "left").withColumn("component", F.coalesce("component", "id")), "local")
    late = local.select("ilon", "ilat", (F.col("t1") + F.expr("interval 1 day")).cast("date").alias("t0"), F.col("component").alias("src"))
    seams = late.join(local.select("ilon", "ilat", "t0", F.col("component").alias("dst")), ["ilon", "ilat", "t0"]).select("src", "dst").distinct()
    across = connected_components(seams).select(F.col("id").alias("component"), F.col("component").alias("root"))
    merged = ws.save(local.join(across, "component", "left").withColumn("root", F.coalesce("root", "component")), "merged")
    numbers = number_in_order(merged.select("root").distinct(), "root", "label", ws)
    spread = merged.join(numbers, "root").select("ilon", "ilat", "label", F.explode(F.sequence("t0", "t1")).alias("time"))
    return days.join(spread, ["ilon", "ilat", "time"])
