"""Checks of what a store holds against the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def month_steps(hourly: DataFrame, ts: str) -> DataFrame:
    """(month, steps, expected, complete): distinct hours of each month against days x 24."""
    h = hourly.select(F.date_trunc("hour", F.col(ts).cast("timestamp_ntz")).alias("h")).distinct()
    month = F.trunc(F.to_date("h"), "month")
    out = h.groupBy(month.alias("month")).agg(F.count("*").alias("steps"))
    expected = F.day(F.last_day("month")).cast("long") * 24
    return out.select("month", "steps", expected.alias("expected"), (F.col("steps") == expected).alias("complete"))


def missing_months(cube: DataFrame, by: list[str], first_year: int, last_year: int) -> DataFrame:
    """(by, year, months) for series and years with data in fewer than twelve months, none included."""
    have = cube.groupBy(*by, F.year("time").alias("year")).agg(F.count_distinct(F.month("time")).alias("months"))
    want = cube.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(first_year), F.lit(last_year))).alias("year"))
    return want.join(have, [*by, "year"], "left").withColumn("months", F.coalesce("months", F.lit(0).cast("long"))).where("months < 12")


def grid_shape(cube: DataFrame, nlon: int, nlat: int) -> DataFrame:
    """(month, steps, lons, lats, complete): distinct days and axis positions of each month against the calendar and the grid."""
    month = F.trunc("time", "month")
    out = cube.groupBy(month.alias("month")).agg(F.count_distinct("time").alias("steps"), F.count_distinct("ilon").alias("lons"), F.count_distinct("ilat").alias("lats"))
    right = (F.col("steps") == F.day(F.last_day("month"))) & (F.col("lons") == nlon) & (F.col("lats") == nlat)
    return out.withColumn("complete", right)
