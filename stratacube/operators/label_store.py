"""A stored labelling that grows by years: new days are labelled by themselves and joined to what is there at the seam.

An event is named by the place of its first voxel in scan order, so a name never depends on what comes later, and it tells
the day on which the event began.  Appending days needs the runs of the touching day only.  Where new days join two events
that were apart, the younger takes the older's name; it can be found in the years from its first day on, and these years
alone are written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacube.operators.components import number_in_order, run_graph
from stratacube.operators.graph import connected_components
from stratacube.sources.workspace import Workspace
from stratacube.sources.years import extend_years, in_years, stored_years

_ORDER = ["ilat", "ilon", "t0"]


class LabelStore:
    """Runs (ilon, ilat, t0, t1, label) of labelled days at ``path``, one folder a year; a run ends with its year."""

    def __init__(self, spark: SparkSession, path: str, nlon: int, nlat: int, wrap: bool = True, epoch: str = "1970-01-01"):
        self.spark, self.path, self.nlon, self.nlat, self.wrap, self.epoch = spark, path, nlon, nlat, wrap, epoch

    def years(self) -> list[int]:
        return stored_years(self.spark, self.path)

    def runs(self) -> DataFrame:
        return self.spark.read.schema("ilon int, ilat int, t0 date, t1 date, label long, year int").parquet(self.path)

    def _day(self, label: Column) -> Column:
        """Day on which the event of that name began."""
        return F.date_add(F.lit(self.epoch).cast("date"), F.floor(label / (self.nlon * self.nlat)).cast("int"))

    def append(self, days: DataFrame) -> list[int]:
        """Add the days (ilon, ilat, time), all later than those there; returns the earlier years that were written again.

        No days, no change.  Days that are not later than the stored ones are an error.
        """
        ws = Workspace(self.spark, "label_store")
        found, edges = run_graph(ws.save(days.select(F.col("ilon").cast("int"), F.col("ilat").cast("int"), "time"), "days"), self.nlon, self.nlat, self.wrap, self.epoch, ws=ws)
        first = found.agg(F.min("t0")).first()[0]
        if first is None:
            return []
        years = self.years()
        local = ws.save(found.join(connected_components(edges), "id", "left").select("ilon", "ilat", "t0", "t1", F.coalesce("component", "id").alias("label")), "local")
        if not years:
            extend_years(None, self._by_year(local), self.path, _ORDER, ws)
            return []
        last = in_years(self.runs(), years[-1:]).agg(F.max("t1")).first()[0]
        if last >= first:
            raise ValueError(f"days from {first} on cannot follow a store that ends on {last}")
        yesterday = F.date_sub(F.lit(first), 1)
        touching = self.runs().where((F.col("year") == F.year(yesterday)) & (F.col("t1") == yesterday)).select("ilon", "ilat", F.col("label").alias("src"))
        seam = touching.join(local.where(F.col("t0") == F.lit(first)).select("ilon", "ilat", F.col("label").alias("dst")), ["ilon", "ilat"]).select("src", "dst").distinct()
        names = ws.save(connected_components(seam).where("id <> component"), "names")
        new = self._by_year(local.join(names, F.col("label") == F.col("id"), "left").select("ilon", "ilat", "t0", "t1", F.coalesce("component", "label").alias("label")))
        old = names.where(self._day(F.col("id")) < F.lit(first))
        span = old.select(F.explode(F.sequence(F.year(self._day(F.col("id"))), F.year(yesterday))).alias("year")).distinct()
        again = sorted(r["year"] for r in span.collect())  # years
        now = [r["year"] for r in new.select("year").distinct().collect()]
        touched = sorted(set(again) | (set(now) & set(years)))
        kept = None
        if touched:
            kept = in_years(self.runs(), touched).join(old, F.col("label") == F.col("id"), "left").select("ilon", "ilat", "t0", "t1", F.coalesce("component", "label").alias("label"), "year")
        extend_years(kept, new, self.path, _ORDER, ws)
        return touched

    @staticmethod
    def _by_year(runs: DataFrame) -> DataFrame:
        """Runs cut at the ends of years."""
        cut = runs.withColumn("year", F.explode(F.sequence(F.year("t0"), F.year("t1"))))
        start, end = F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31))
        return cut.select("ilon", "ilat", F.greatest("t0", start).alias("t0"), F.least("t1", end).alias("t1"), "label", "year")

    def voxels(self, numbered: bool = False) -> DataFrame:
        """(ilon, ilat, time, label) of all days; with ``numbered`` labels 1..n in the order of the events' first voxels."""
        runs = self.runs()
        if numbered:
            ws = Workspace(self.spark, "label_numbers")
            runs = runs.join(number_in_order(runs.select("label").distinct(), "label", "number", ws), "label").drop("label").withColumnRenamed("number", "label")
        return runs.select("ilon", "ilat", F.explode(F.sequence("t0", "t1")).alias("time"), "label")
