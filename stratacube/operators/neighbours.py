"""Neighbourhoods on the grid, in space or in space and time: a table of offsets is exploded and joined by cell and day."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacube.operators.windows import min_run_filter

Offset = tuple[int, int, int]


def _halves(widths: tuple[int, ...]) -> list[int]:
    if not widths or any(w < 1 or w % 2 == 0 for w in widths):
        raise ValueError("a neighbourhood has odd widths")
    return [w // 2 for w in widths]


def diamond(*widths: int) -> list[tuple[int, ...]]:
    """Offsets from the centre whose city-block distance is below the mean of (width + 1) / 2 over the axes.

    One width stands for two equal axes.
    """
    halves = _halves(widths * 2 if len(widths) == 1 else widths)
    limit = sum(h + 1 for h in halves)
    return [o for o in box(*(2 * h + 1 for h in halves)) if sum(map(abs, o)) * len(halves) < limit]


def box(*widths: int) -> list[tuple[int, ...]]:
    """All offsets of a window, the first axis fastest."""
    return [o[::-1] for o in itertools.product(*(range(-h, h + 1) for h in reversed(_halves(widths))))]


def _spread(offsets: list[tuple[int, ...]]) -> list[Offset]:
    return [(*o, 0)[:3] for o in offsets]


def _around(days: DataFrame, offsets: list[tuple[int, ...]], nlon: int | None, *more: str) -> DataFrame:
    """Every day of ``days`` seen from each cell and day that has it in its neighbourhood, with the place of the offset."""
    table = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dt).alias("dt"), F.lit(k).alias("k")) for k, (dx, dy, dt) in enumerate(_spread(offsets))))
    moved = days.select("ilon", "ilat", "time", *more, F.explode(table).alias("o"))
    lon = F.col("ilon") - F.col("o.dx")
    when = F.date_sub("time", F.col("o.dt")) if any(dt for _, _, dt in _spread(offsets)) else F.col("time")
    return moved.select((F.pmod(lon, F.lit(nlon)) if nlon else lon).cast("int").alias("ilon"), (F.col("ilat") - F.col("o.dy")).cast("int").alias("ilat"), when.alias("time"), *more, F.col("o.k").alias("place"))


def count_neighbours(days: DataFrame, width: int | tuple[int, int, int] = 3, nlon: int | None = None) -> DataFrame:
    """(cell, time, n): true days of the diamond around each cell and day that has any."""
    return _around(days, diamond(*(width if isinstance(width, tuple) else (width,))), nlon).groupBy("ilon", "ilat", "time").agg(F.count("*").alias("n"))


def diamond_filter(days: DataFrame, least: int, width: int | tuple[int, int, int] = 3, nlon: int | None = None) -> DataFrame:
    """True days whose diamond, in space or with three widths in space and time, holds at least ``least`` true days."""
    return days.join(count_neighbours(days, width, nlon).where(F.col("n") >= least), ["ilon", "ilat", "time"])


def diamond_run_filter(days: DataFrame, least: int, length: int, period: DataFrame, width: int = 3, nlon: int | None = None, edge: str = "strict") -> DataFrame:
    """True days with ``least`` true days in the diamond of their own day and in a run of at least ``length`` days."""
    kept = min_run_filter(days, period, length, edge)
    return kept.join(count_neighbours(days, width, nlon).where(F.col("n") >= least), ["ilon", "ilat", "time"])


def _present(offsets: list[tuple[int, ...]], nlon: int | None, nlat: int, last_lon: int | None) -> Column:
    """How many of the offsets lie on the grid and in the period (first, last) from a cell and day."""
    inside = []
    for dx, dy, dt in _spread(offsets):
        here = (F.col("ilat") + dy).between(0, nlat - 1) & F.date_add("time", dt).between(F.col("first"), F.col("last"))
        inside.append((here & (F.col("ilon") + dx).between(0, last_lon) if nlon is None and last_lon is not None else here).cast("int"))
    return sum(inside[1:], inside[0])


def opening(days: DataFrame, width: int | tuple[int, int, int] = 3, nlon: int | None = None) -> DataFrame:
    """Erosion, then dilation, within the mask: true days covered by a diamond of true days; outside the grid counts as false."""
    offsets = diamond(*(width if isinstance(width, tuple) else (width,)))
    eroded = count_neighbours(days, width, nlon).where(F.col("n") == len(offsets)).drop("n")
    grown = _around(eroded, offsets, nlon).select("ilon", "ilat", "time").distinct()
    return days.join(grown, ["ilon", "ilat", "time"], "left_semi")


def opening_clipped(days: DataFrame, width: int | tuple[int, int, int], nlat: int, period: DataFrame, nlon: int | None = None, last_lon: int | None = None) -> DataFrame:
    """As ``opening``, with diamonds clipped at the ends of the grid and of the period (first, last): what is outside does not count."""
    offsets = diamond(*(width if isinstance(width, tuple) else (width,)))
    span = period.agg(F.min("first").alias("first"), F.max("last").alias("last"))
    seen = count_neighbours(days, width, nlon).join(days.select("ilon", "ilat", "time"), ["ilon", "ilat", "time"]).crossJoin(F.broadcast(span))  # one row
    eroded = seen.where(F.col("n") == _present(offsets, nlon, nlat, last_lon)).select("ilon", "ilat", "time")
    grown = _around(eroded, offsets, nlon).select("ilon", "ilat", "time").distinct()
    return days.join(grown, ["ilon", "ilat", "time"], "left_semi")


def window_mode(cube: DataFrame, value: str, width: int = 3, nlon: int | None = None) -> DataFrame:
    """(cell, time, value, mode): most frequent value in the diamond of each row of ``cube``; the smallest of equally frequent ones."""
    return _mode(cube, value, diamond(width), nlon, value)


def box_mode(cube: DataFrame, value: str, widths: tuple[int, int, int], nlon: int | None = None, mask: Column | None = None) -> DataFrame:
    """(cell, time, value, mode) over a box in space and time; 0 where ``mask`` does not hold for the row.

    Of equally frequent values the one that is complete first, in the order of the window, first axis fastest.
    """
    out = _most(_box_counts(cube, value, widths, nlon), value, "last")
    return out.withColumn("mode", F.when(mask, F.col("mode")).otherwise(F.lit(0).cast(out.schema["mode"].dataType))) if mask is not None else out


def _mode(cube: DataFrame, value: str, offsets: list[tuple[int, ...]], nlon: int | None, tie: str) -> DataFrame:
    centre = _spread(offsets).index((0, 0, 0))
    # an offset seen from the other side: the window's place k of a row holds the row that lies at offset k from it
    seen = _around(cube, offsets, nlon, value).groupBy("ilon", "ilat", "time", value).agg(F.count("*").alias("n"), F.max("place").alias("last"), F.max((F.col("place") == centre).cast("int")).alias("own"))
    return _most(seen, value, tie)


def _box_counts(cube: DataFrame, value: str, widths: tuple[int, int, int], nlon: int | None) -> DataFrame:
    """(cell, time, value, n, last, own): how often a box has a value, the last place that has it, and whether the centre does.

    One axis after the other: a row is spread over the sum of the widths, not over their product.  Time comes last, where
    a cell's days, and the ranking after it, stay in the partition in which the second axis has put the cell.
    """
    key = ["ilon", "ilat", "time", value]
    seen, stride = cube.select(*key, F.lit(1).cast("long").alias("n"), F.lit(0).alias("last"), F.lit(1).alias("own")), 1
    for axis, half in zip(key[:3], _halves(widths), strict=True):
        o = F.col("o")
        place = F.date_sub("time", o) if axis == "time" else F.pmod(F.col(axis) - o, F.lit(nlon)) if axis == "ilon" and nlon else F.col(axis) - o
        moved = seen.select("*", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("o"))
        moved = moved.withColumns({axis: place if axis == "time" else place.cast("int"), "last": F.col("last") + (o + half) * stride, "own": F.when(o == 0, F.col("own")).otherwise(0)})
        moved = moved.repartition("ilon", "ilat") if axis == "ilat" else moved
        seen = moved.groupBy(*key).agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("own").alias("own"))
        stride *= 2 * half + 1
    return seen


def _most(seen: DataFrame, value: str, tie: str) -> DataFrame:
    """A row's own value comes with it through the aggregate, so the cube is not joined again; no other columns are kept."""
    at = Window.partitionBy("ilon", "ilat", "time")
    best = F.row_number().over(at.orderBy(F.desc("n"), tie))
    mine = F.max(F.when(F.col("own") == 1, F.struct(F.col(value).alias("v")))).over(at)
    top = seen.withColumns({"r": best, "mine": mine}).where("r = 1 AND mine IS NOT NULL")
    return top.select("ilon", "ilat", "time", F.col("mine.v").alias(value), F.col(value).alias("mode"))
