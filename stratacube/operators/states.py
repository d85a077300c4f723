"""Statistics as stored partial states: declared once, kept by year, merged on demand.

A statistic says how rows become a partial state, how two states become one, and what a state tells in the end.  The
partial states of a year are an aggregate over its rows alone; a year that is added or computed again touches its own
folder and no other.  Merging reads states, never rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacube.functions.columns import known
from stratacube.sources.workspace import Workspace
from stratacube.sources.years import in_years, replace_years, stored_years

#: States of one group that one merge takes at a time.
AT_ONCE = 512


@dataclass(frozen=True)
class Statistic:
    """``partial`` is an aggregate that gives a struct, ``merge`` makes one of two such structs, ``final`` names results."""

    partial: Column
    merge: Callable[[Column, Column], Column]
    final: Callable[[Column], dict[str, Column]]


def moments(value: Column, weight: Column, near: float = 0.0) -> Statistic:
    """Weighted mean and variance; rows of unknown value or of no weight are left out.

    Rows add up sums about ``near``, a value that the caller knows to be near the data; a state holds the mean and the
    summed squares about it, and states merge pairwise about their common mean, so states with different means, and of
    different ``near``, combine without cancelling.
    """
    x = known(value.cast("double"))
    use = x.isNotNull() & (weight > 0)
    w, d = F.when(use, weight), F.when(use, x - near)
    sw = F.coalesce(F.sum(w), F.lit(0.0))
    swd, swd2 = F.coalesce(F.sum(w * d), F.lit(0.0)), F.coalesce(F.sum(w * d * d), F.lit(0.0))
    safe = F.nullif(sw, F.lit(0.0))
    partial = F.struct(
        F.count(w).alias("n"), sw.alias("sw"), F.coalesce(F.sum(w * w), F.lit(0.0)).alias("sw2"),
        F.coalesce(near + swd / safe, F.lit(0.0)).alias("mean"), F.coalesce(F.greatest(swd2 - swd * swd / safe, F.lit(0.0)), F.lit(0.0)).alias("m2"),
    )

    def merge(a: Column, b: Column) -> Column:
        total = F.nullif(a["sw"] + b["sw"], F.lit(0.0))
        gap, share = b["mean"] - a["mean"], F.coalesce(b["sw"] / total, F.lit(0.0))
        return F.struct(
            (a["n"] + b["n"]).alias("n"), (a["sw"] + b["sw"]).alias("sw"), (a["sw2"] + b["sw2"]).alias("sw2"),
            (a["mean"] + gap * share).alias("mean"), (a["m2"] + b["m2"] + gap * gap * a["sw"] * share).alias("m2"),
        )

    def final(s: Column) -> dict[str, Column]:
        some = F.nullif(s["sw"], F.lit(0.0))
        var = s["m2"] / some
        return {
            "n": s["n"], "sum_w": s["sw"], "mean": F.when(s["n"] > 0, s["mean"]), "var_uncorrected": var, "var_analytic": var / F.nullif(1 - s["sw2"] / (some * some), F.lit(0.0)),
            "var_frequency": var * s["sw"] / F.nullif(F.when(s["sw"] > 1, s["sw"] - 1).otherwise(0.0), F.lit(0.0)),
        }

    return Statistic(partial, merge, final)


def histogram(code: Column, weight: Column, bins: int) -> Statistic:
    """Summed weight of each code 0 .. bins - 1."""
    partial = F.struct(F.array(*(F.coalesce(F.sum(F.when(code == k, weight)), F.lit(0.0)) for k in range(bins))).alias("area"))
    return Statistic(partial, lambda a, b: F.struct(F.zip_with(a["area"], b["area"], lambda x, y: x + y).alias("area")), lambda s: {"area": s["area"]})


def extent(value: Column) -> Statistic:
    """Smallest and largest known value."""
    x = known(value.cast("double"))
    partial = F.struct(F.min(x).alias("low"), F.max(x).alias("high"))
    return Statistic(partial, lambda a, b: F.struct(F.least(a["low"], b["low"]).alias("low"), F.greatest(a["high"], b["high"]).alias("high")), lambda s: {"low": s["low"], "high": s["high"]})


class StateTable:
    """Partial states of ``statistics`` (name -> Statistic) at ``path`` for each group of ``by`` and year."""

    def __init__(self, spark: SparkSession, path: str, statistics: dict[str, Statistic], by: list[str]):
        self.spark, self.path, self.statistics, self.by = spark, path, statistics, by

    def years(self) -> list[int]:
        return stored_years(self.spark, self.path)

    def update(self, rows: DataFrame) -> None:
        """Compute the states of the years in ``rows`` (with a column year), which must be whole, and replace those years."""
        states = rows.groupBy("year", *self.by).agg(*(s.partial.alias(n) for n, s in self.statistics.items()))
        replace_years(Workspace(self.spark, "states").save(states, "states"), self.path, self.by)

    def states(self, years: list[int] | None = None) -> DataFrame:
        table = self.spark.read.parquet(self.path)
        return table if years is None else in_years(table, years)

    def merged(self, by: list[str], years: list[int] | None = None) -> DataFrame:
        """(by, results) of the states of ``years``, all by default, merged over every key that is not in ``by``.

        States meet in fixed order.  Where a group has more than ``AT_ONCE`` of them they are merged part by part first.
        """
        keys = [c for c in ("year", *self.by) if c not in by]
        held = self.states(years).select(*by, F.xxhash64(*(F.col(c) for c in keys), F.lit(0)).alias("__at"), *self.statistics)
        most = held.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        while most > AT_ONCE:
            parts = -(-most * 2 // AT_ONCE)
            held = self._merge(held.withColumn("__part", F.pmod("__at", F.lit(parts))), [*by, "__part"]).withColumnRenamed("__part", "__at")
            most = parts
        final = [c.alias(f"{n}_{k}" if len(self.statistics) > 1 else k) for n, s in self.statistics.items() for k, c in s.final(F.col(n)).items()]
        return self._merge(held, by).select(*by, *final)

    def _merge(self, held: DataFrame, by: list[str]) -> DataFrame:
        lists = held.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__at", *self.statistics))).alias("__s"))
        one = lambda n, s: F.aggregate(F.slice("__s", F.lit(2), F.size("__s")), F.col("__s")[0][n], lambda a, b: s.merge(a, b[n])).alias(n)
        return lists.select(*by, *(one(n, s) for n, s in self.statistics.items()))
