"""Per-cell windows along time.  All share the partitioning by cell, so that a chain of them shuffles once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ("ilon", "ilat")


def rank_transform(cube: DataFrame, value: Column, out: str, multiplier: float = 1.0, time: str = "time", cell=CELL) -> DataFrame:
    """Rank / N within each cell, ties by time; NaN and then null come last and count in N."""
    w = Window.partitionBy(*cell)
    return cube.withColumn(out, F.row_number().over(w.orderBy((value * multiplier).asc_nulls_last(), F.col(time))) / F.count(F.lit(1)).over(w))


def running_mean(cube: DataFrame, value: Column, width: int, out: str, time: str = "time", cell=CELL) -> DataFrame:
    """Trailing mean over ``width`` rows, tapered at the start; null where the frame holds a null."""
    w = Window.partitionBy(*cell).orderBy(time).rowsBetween(1 - width, 0)
    return cube.withColumn(out, F.when(F.count(value).over(w) == F.count(F.lit(1)).over(w), F.avg(value).over(w)))


def rolling_sum(cube: DataFrame, value: Column, before: int, after: int, out: str, time: str = "time", cell=CELL) -> DataFrame:
    """Sum over the rows from ``before`` earlier to ``after`` later, clipped at the ends."""
    if before < 0 or after < 0:
        raise ValueError("a rolling frame reaches back and ahead by zero or more rows")
    return cube.withColumn(out, F.sum(value).over(Window.partitionBy(*cell).orderBy(time).rowsBetween(-before, after)))


def rolling_all(cube: DataFrame, flag: Column, start: int, stop: int, out: str, time: str = "time", cell=CELL) -> DataFrame:
    """Whether ``flag`` holds in all rows from offset ``start`` to ``stop``; the first row looks at itself."""
    w = Window.partitionBy(*cell).orderBy(time).rowsBetween(start, stop)
    return cube.withColumn(out, F.coalesce(F.min(flag.cast("int")).over(w), flag.cast("int")) == 1)


def runs(days: DataFrame, time: str = "time", cell=CELL) -> DataFrame:
    """(cell, t0, t1, n): maximal runs of consecutive days present in ``days``."""
    w = Window.partitionBy(*cell).orderBy(time)
    island = F.datediff(F.col(time), F.lit("1970-01-01").cast("date")) - F.row_number().over(w)
    return days.withColumn("island", island).groupBy(*cell, "island").agg(F.min(time).alias("t0"), F.max(time).alias("t1"), F.count("*").alias("n")).drop("island")


def min_run_filter(days: DataFrame, period: DataFrame, length: int = 4, edge: str = "replicate", time: str = "time", cell=CELL) -> DataFrame:
    """Days of runs of at least ``length``; with ``replicate`` also of runs that touch the first or last day.

    ``period`` holds the first and last of the processed days; of several rows the widest span counts.
    """
    if edge not in ("replicate", "strict"):
        raise ValueError(f"unknown edge rule {edge!r}")
    w = Window.partitionBy(*cell).orderBy(time)
    run = Window.partitionBy(*cell, "island")
    marked = days.withColumn("island", F.datediff(F.col(time), F.lit("1970-01-01").cast("date")) - F.row_number().over(w))
    marked = marked.withColumns({"run_n": F.count(F.lit(1)).over(run), "run_t0": F.min(time).over(run), "run_t1": F.max(time).over(run)})
    if edge == "strict":
        return marked.where(F.col("run_n") >= length).drop("island", "run_n", "run_t0", "run_t1")
    joined = marked.crossJoin(F.broadcast(period.agg(F.min("first").alias("first"), F.max("last").alias("last"))))  # one row
    return joined.where((F.col("run_n") >= length) | (F.col("run_t0") == F.col("first")) | (F.col("run_t1") == F.col("last"))).drop("island", "run_n", "run_t0", "run_t1", "first", "last")


def share_of_total(rows: DataFrame, value: str, out: str, by: list[str], factor: float = 100.0) -> DataFrame:
    """value / sum(value) * factor within each group, rows kept."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return rows.withColumn(out, F.col(value) * factor / F.nullif(total, F.lit(0).cast("double")))


def run_offsets(rows: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """Run-length encoding of ``value`` along ``order``: (by, value, run length, rows before the run)."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    numbered = rows.withColumn("__change", change).withColumn("__run", F.sum("__change").over(w))
    lengths = numbered.groupBy(*by, "__run").agg(F.first(value).alias(value), F.count("*").alias("run_length"))
    before = F.sum("run_length").over(Window.partitionBy(*by).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    return lengths.withColumn("offset", F.coalesce(before, F.lit(0))).withColumnRenamed("__run", "run")
