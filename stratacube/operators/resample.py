"""Resampling in time and space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacube.functions.columns import known


def daily_aggregate(hourly: DataFrame, aggs: dict[str, Column], ts: str = "ts", cell=("ilon", "ilat")) -> DataFrame:
    """Tumbling days: one row per cell and day with the named aggregates."""
    return hourly.groupBy(*cell, F.to_date(ts).alias("time")).agg(*(c.alias(k) for k, c in aggs.items()))


def complete_daily_sum(hourly: DataFrame, value: str, steps: int = 24, ts: str = "ts", cell=("ilon", "ilat")) -> DataFrame:
    """Daily sums; null on days whose ``value`` is not known in all ``steps`` hours."""
    x = known(F.col(value).cast("double"))
    out = hourly.groupBy(*cell, F.to_date(ts).alias("time")).agg(F.count(x).alias("n_steps"), F.sum(x).alias("total"))
    return out.select(*cell, "time", "n_steps", F.when(F.col("n_steps") == steps, F.col("total")).alias(value))


def block_aggregate(series: DataFrame, agg: Column, size: int, order: str, out: str, by: list[str], partial: str = "error") -> DataFrame:
    """Consecutive blocks of ``size`` rows along ``order``.

    A series whose length is no multiple of ``size`` fails the job; with partial="drop" its last block is left out.
    """
    if partial not in ("error", "drop"):
        raise ValueError(f"unknown rule for a block that is not full: {partial!r}")
    position = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    blocks = series.withColumn("block", F.floor(position / size)).groupBy(*by, "block").agg(agg.alias(out), F.count(F.lit(1)).alias("__n"))
    full = F.col("__n") == size
    if partial == "error":
        return blocks.where(F.when(full, F.lit(True)).otherwise(F.raise_error(F.lit(f"the length of a series is no multiple of {size}")).cast("boolean"))).drop("__n")
    return blocks.where(full).drop("__n")


def coarsen(cube: DataFrame, value: str, factor: int, by: list[str]) -> DataFrame:
    """Means of what is known over factor x factor cells."""
    x = known(F.col(value).cast("double"))
    return cube.groupBy(F.floor(F.col("ilon") / factor).alias("ilon"), F.floor(F.col("ilat") / factor).alias("ilat"), *by).agg(F.avg(x).alias(value))


def ensemble_mean(members: DataFrame, value: str, by: list[str], low: float = 0.0, high: float = 40.0, more_than: int = 5) -> DataFrame:
    """Mean over members of values strictly inside (low, high), null unless more than ``more_than`` are."""
    good = F.when((F.col(value) > low) & (F.col(value) < high), F.col(value))
    out = members.groupBy(*by).agg(F.count(good).alias("n_good"), F.avg(good).alias("m"))
    return out.select(*by, "n_good", F.when(F.col("n_good") > more_than, F.col("m")).alias(value))


def mid_period(series: DataFrame, year_end: Column, time: str = "time", by: list[str] | None = None) -> DataFrame:
    """Move each period start to the middle of its period, the last one to the middle of what is left of its year."""
    nxt = F.coalesce(F.lead(time).over(Window.partitionBy(*(by or [])).orderBy(time)), year_end)
    return series.withColumn("mid", F.datediff(F.col(time), F.lit("1970-01-01").cast("date")) + F.datediff(nxt, F.col(time)) / 2.0)


def interpolate_days(days: DataFrame, series: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Linear in time between the nodes (by, mid, value) of ``series`` at the days (by, time) asked for; null outside.

    Days and nodes are put in one sequence per series, so the nearest nodes come from one window, not a range join.
    """
    at = F.datediff(F.col("time"), F.lit("1970-01-01").cast("date")).cast("double")
    nodes = series.select(*by, F.lit(None).cast("date").alias("time"), F.col("mid").alias("at"), F.col("mid").alias("node"), F.col(value).cast("double").alias("v"))
    asked = days.select(*by, "time", at.alias("at"), F.lit(None).cast("double").alias("node"), F.lit(None).cast("double").alias("v"))
    both = nodes.unionByName(asked)
    # the last one seen, forwards and backwards: frames that only grow
    back, ahead = (Window.partitionBy(*by).orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("at"), F.desc("at")))
    pick = lambda c, frame: F.last(c, ignorenulls=True).over(frame)
    named = both.withColumns({"x0": pick("node", back), "y0": pick("v", back), "x1": pick("node", ahead), "y1": pick("v", ahead)})
    blend = F.when(F.col("x1") == F.col("x0"), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("at") - F.col("x0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0)))
    return named.where(F.col("time").isNotNull()).select(*by, "time", F.when(F.col("x0").isNotNull() & F.col("x1").isNotNull(), blend).alias(value))
