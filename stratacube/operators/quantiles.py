"""Exact quantiles of groups that fit one buffer: a cell, or a cell's day of year.  Larger groups: ``selection``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _probs(probs: list[float]) -> Column:
    return F.array(*(F.lit(float(p)) for p in probs))


def group_quantiles(rows: DataFrame, value: Column, probs: list[float], by: list[str], rule: Column | None = None) -> DataFrame:
    """(by, quantile, value): linear (type 7) quantiles of the values that pass ``rule``; null values are skipped."""
    use = F.when(rule, value) if rule is not None else value
    got = rows.where(use.isNotNull()).groupBy(*by).agg(F.percentile(use, _probs(probs)).alias("__q"))
    return got.select(*by, F.posexplode("__q").alias("__i", "value")).select(*by, F.element_at(_probs(probs), F.col("__i") + 1).alias("quantile"), "value")


def day_of_year_quantiles(series: DataFrame, value: str, probs: list[float], half_width: int = 15, by=("ilon", "ilat"), time: str = "time") -> DataFrame:
    """(by, doy, quantile, value): pooled over +-half_width rows around each day of year of every year.

    The day of year runs over a leap year; Feb-29 is anchored to Mar-01 in other years.  Frames wrap at the ends
    of the series, and values count once for every frame that holds them.  Each cell's row number serves as its
    time axis, so the series should be complete.
    """
    w = Window.partitionBy(*by)
    axis = series.select(*by, time, F.col(value).alias("__v"), F.row_number().over(w.orderBy(time)).alias("__it"), F.count(F.lit(1)).over(w).alias("__n"))
    # the ring: rows near an end once more beyond the other end; all stays in the partitioning by cell
    turns = F.sequence(-F.ceil(F.lit(half_width) / F.col("__n")), F.ceil(F.lit(half_width) / F.col("__n")))
    ring = axis.withColumn("__turn", F.explode(turns)).withColumn("__at", F.col("__it") + F.col("__turn") * F.col("__n")).where(F.col("__at").between(F.lit(1 - half_width), F.col("__n") + half_width))
    framed = ring.withColumn("__frame", F.collect_list("__v").over(w.orderBy("__at").rowsBetween(-half_width, half_width))).where("__turn = 0")
    key = F.date_format(F.col(time), "MM-dd")
    leap = F.day(F.last_day(F.make_date(F.year(time), F.lit(2), F.lit(1)))) == 29
    days = F.when((key == "03-01") & ~leap, F.array(F.lit("02-29"), key)).otherwise(F.array(key))
    pooled = framed.select(*by, F.explode(days).alias("doy"), "__frame").select(*by, "doy", F.explode("__frame").alias("__v"))
    got = pooled.groupBy(*by, "doy").agg(F.percentile("__v", _probs(probs)).alias("__q"))
    return got.select(*by, "doy", F.posexplode("__q").alias("__i", "value")).select(*by, "doy", F.element_at(_probs(probs), F.col("__i") + 1).alias("quantile"), "value")
