"""Exact quantiles of groups of any size, by selecting the values at given ranks.

No group is ever sorted or held as a whole.  The range of a group's values is cut into parts, the rows of each part are
counted, and only the parts that hold a wanted rank are looked at again, until few enough rows are left to be put in
order.  The parts are equal in turn on a linear scale and on one of powers, so that neither outliers nor values of many
magnitudes take long.  Every count is an aggregate that is summed up before the shuffle, so a group that holds most rows costs no more
than many small ones; equal values never part, and a range of one value is settled however many rows hold it.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacube.functions.columns import known
from stratacube.sources.workspace import Workspace

#: Parts that a range is cut into, and rows of a range that are put in order in one task.
PARTS, ROWS = 256, 1 << 20
#: Ranges that are broadcast; more of them are joined.
MOST_RANGES = 1 << 17
#: Rounds in which a range shrinks; most leave a 256th.
MOST_ROUNDS = 100


def _linear(x: Column) -> Column:
    """A quarter of x, so that differences do not overflow."""
    return F.greatest(F.least(x, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max)) / 4


def _powers(x: Column) -> Column:
    """The power of two of x, moved so that it is positive, with the sign of x."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(_linear(x)) * 4 + F.lit(5e-324)) + 1100))


def _part(v: Column, lo: Column, hi: Column, scale) -> Column:
    """Which of the parts of [lo, hi], equal on ``scale``, holds v; grows with v, 0 for lo and the last for hi."""
    share = (scale(v) - scale(lo)) / F.nullif(scale(hi) - scale(lo), F.lit(0.0))
    inner = F.least(F.floor(share * PARTS), F.lit(PARTS - 1))
    return F.when(v == lo, 0).when(v == hi, PARTS - 1).otherwise(F.coalesce(inner, F.lit(1))).cast("int")


def _within(base: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of ``base`` with the range (of their group) that holds them."""
    side = ranges.withColumnRenamed("k", "of")
    if ranges.count() <= MOST_RANGES:
        side = F.broadcast(side)
    return base.join(side, (F.col("k") == F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi"))).drop("of")


def values_at(base: DataFrame, wanted: DataFrame, ws: Workspace, rows: int = ROWS) -> DataFrame:
    """(k, rank, value) for ``wanted`` (k, rank from 0, lo, hi, below, inside) in a written ``base`` (k, v).

    lo and hi bound the range that holds the rank, below counts the rows under it and inside those in it.
    """
    for r in range(MOST_ROUNDS):
        wide = wanted.where((F.col("inside") > rows) & (F.col("lo") < F.col("hi"))).select("k", "lo", "hi", "below").distinct()
        if wide.isEmpty():
            break
        parts = _within(base, wide).groupBy("k", "lo", "below", _part(F.col("v"), F.col("lo"), F.col("hi"), (_linear, _powers)[r % 2]).alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        before = F.sum("c").over(Window.partitionBy("k", "lo").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.select(F.col("k").alias("of"), F.col("lo").alias("was"), (F.col("below") + F.coalesce(before, F.lit(0))).alias("first"), "c", "a", "b")
        narrow = wanted.where((F.col("inside") > rows) & (F.col("lo") < F.col("hi"))).join(parts, (F.col("k") == F.col("of")) & (F.col("lo") == F.col("was")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("c")))
        narrow = narrow.select("k", "rank", F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("first").alias("below"), F.col("c").alias("inside"))
        wanted = ws.save(narrow.unionByName(wanted.where(~((F.col("inside") > rows) & (F.col("lo") < F.col("hi"))))), f"wanted{r}")
    else:
        raise RuntimeError("ranges did not settle")
    settled = wanted.where("lo = hi").select("k", "rank", F.col("lo").alias("value"))
    open_ = wanted.where("lo < hi")
    order = Window.partitionBy("k", "lo").orderBy("v")
    placed = _within(base, open_.select("k", "lo", "hi", "below").distinct()).select("k", "v", (F.col("below") + F.row_number().over(order) - 1).alias("rank"))
    return settled.unionByName(placed.join(open_.select("k", "rank"), ["k", "rank"]).select("k", "rank", F.col("v").alias("value")))


def exact_quantiles(table: DataFrame, value: Column, probs: list[float], by: list[str], rows: int = ROWS) -> DataFrame:
    """(by, quantile, value): linear (type 7) quantiles of the known values of each group; ``by`` may be empty.

    Null and NaN values are skipped, and a group without others is left out; a null key is a group of its own.  Ranges of
    more than ``rows`` rows are never put in order.
    """
    ws = Workspace(table.sparkSession, "quantiles")
    key = F.struct(*by) if by else F.lit(0)
    base = ws.save(table.select(key.alias("k"), known(value.cast("double")).alias("v")).where("v IS NOT NULL"), "base")
    sizes = ws.save(base.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "sizes")
    asked = sizes.select("*", F.explode(F.array(*(F.lit(float(p)) for p in probs))).alias("quantile")).withColumn("at", F.col("quantile") * (F.col("n") - 1))
    asked = asked.withColumns({"low": F.floor("at"), "high": F.ceil("at")})
    wanted = asked.select("k", F.explode(F.array("low", "high")).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")).distinct()
    found = ws.save(values_at(base, wanted, ws, rows), "found")
    side = lambda name: found.select(F.col("k").alias(f"k_{name}"), F.col("rank").alias(f"r_{name}"), F.col("value").alias(f"v_{name}"))
    both = reduce(lambda d, name: d.join(side(name), (F.col("k") == F.col(f"k_{name}")) & (F.col(name) == F.col(f"r_{name}"))), ("low", "high"), asked)
    blend = F.when(F.col("low") == F.col("high"), F.col("v_low")).otherwise((F.col("high") - F.col("at")) * F.col("v_low") + (F.col("at") - F.col("low")) * F.col("v_high"))
    return both.select(*(F.col(f"k.{c}").alias(c) for c in by), "quantile", blend.alias("value"))


def exact_five_numbers(table: DataFrame, value: Column, by: list[str], rows: int = ROWS) -> DataFrame:
    """(by, low, q1, median, q3, high)."""
    names = {0.0: "low", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "high"}
    long = exact_quantiles(table, value, list(names), by, rows)
    return long.groupBy(*by).agg(*(F.max(F.when(F.col("quantile") == p, F.col("value"))).alias(n) for p, n in names.items()))
