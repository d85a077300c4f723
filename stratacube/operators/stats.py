"""Area-weighted statistics per event, year, continent and cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacube.functions.columns import area_weight, bit, known, rounded, wmean


def bounds() -> list[Column]:
    return [F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.min("lon").alias("longitude_min"), F.max("lon").alias("longitude_max"), F.min("lat").alias("latitude_min"), F.max("lat").alias("latitude_max")]


def measures(names: list[str], w: Column) -> list[Column]:
    out = []
    for n in names:
        x = known(F.col(n).cast("double"))
        out += [wmean(F.col(n).cast("double"), w).alias(f"{n}_mean"), F.min(x).alias(f"{n}_min"), F.max(x).alias(f"{n}_max")]
    return out


def type_areas(code: Column, w: Column) -> list[Column]:
    """Area-days in each bit of the code, and in hot and dry at once."""
    bits = {"heat": 1, "drought30": 2, "drought90": 4, "drought180": 8}
    out = [F.sum(F.when(bit(code, v), w).otherwise(0.0)).alias(n) for n, v in bits.items()]
    return [*out, F.sum(F.when((code > 1) & (code % 2 == 1), w).otherwise(0.0)).alias("compound")]


def intensity(rank: Column, w: Column, limit: float = 0.01, weigh_all: bool = False) -> Column:
    """Summed depth of the rank below ``limit``; by default only the rank is weighted, as the established figures do."""
    low = F.least(rank, F.lit(limit))
    return F.sum((F.lit(limit) - low) * w if weigh_all else F.lit(limit) - low * w)


def event_statistics(voxels: DataFrame, fields: list[str], ranks: dict[str, str] | None = None, key: str = "label", code: str = "event", land: str | None = "lsm", limit: float = 0.01) -> DataFrame:
    """One row per event: bounds, weighted mean and range of ``fields``, type areas, intensities, land share, volume.

    ``voxels`` are the labelled rows joined with all layers; rows without label, and with ``land`` sea rows, are
    left out.  Partial aggregates make the shuffle as large as the number of events, not of voxels.  An event that is
    hot and dry on more area-days than it is hot, or dry, fails the job.
    """
    w = area_weight(F.col("lat"))
    rows = voxels.where(F.col(key) > 0)
    rows = rows.where(F.col(land) > 0.5) if land else rows
    aggs = [*bounds(), *measures(fields, w), *(type_areas(F.col(code), w) if code else [])]
    if land:
        aggs.append(F.sum(F.when(F.col(land) > 0.5, w).otherwise(0.0)).alias("land_area"))
    aggs += [intensity(F.col(r), w, limit).alias(n) for n, r in (ranks or {}).items()]
    out = rows.groupBy(key).agg(*aggs, F.sum(w).alias("volume"))
    return checked_types(out, key) if code else out


def checked_types(areas: DataFrame, key: str) -> DataFrame:
    """``areas`` as they are; the job fails where compound exceeds heat, or the three droughts together."""
    limit = F.least("heat", F.col("drought30") + F.col("drought90") + F.col("drought180"))
    wrong = F.raise_error(F.concat(F.lit("compound exceeds its parts in event "), F.col(key).cast("string"))).cast("double")
    return areas.withColumn("compound", F.when(F.col("compound") > limit * (1 + 1e-9) + 1e-9, wrong).otherwise(F.col("compound")))


def derive(stats: DataFrame, duration: str = "inclusive", kelvin: list[str] | None = None, shares: list[str] | None = None) -> DataFrame:
    """Duration and mean area, type areas as percent of the volume, K to degrees C.

    duration: 'inclusive' counts both ends; 'plus_two' divides by one day more than that; 'exclusive' counts the
    days between but divides the volume by one more.
    """
    days = F.datediff("end_time", "start_time")
    length, divisor = {"inclusive": (days + 1, days + 1), "plus_two": (days + 1, days + 2), "exclusive": (days, days + 1)}[duration]
    out = stats.withColumns({"duration": length, "area": F.col("volume") / divisor})
    out = out.withColumns({c: F.rint(F.col(c) / F.col("volume") * 100 * 100) / 100 for c in shares or []})
    return out.withColumns({c: F.col(c) - 273.15 for c in kelvin or []})


def mode_nonzero(rows: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """Most frequent value other than 0 (0 where there is no other); of equally frequent ones the first seen."""
    seen = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy((F.col(value) == 0).cast("int"), F.desc("n"), "first"))
    return seen.withColumn("r", rank).where("r = 1").select(*by, F.col(value).alias("mode"))


def weighted_variance(rows: DataFrame, value: str, weight: Column, by: list[str], near: float | None = None) -> DataFrame:
    """Weighted mean and the variance in its uncorrected, analytic and frequency-corrected forms; zero weights are ignored.

    Built from three mergeable sums about a shift, so that partial results combine and large means do not cancel.  The
    shift is ``near``, a value that the caller knows to be near the data, in one pass; without it the group's smallest
    value, found by a pass of its own.
    """
    x = known(F.col(value).cast("double"))
    base = rows.select(*by, x.alias("x"), weight.alias("w")).where("x IS NOT NULL AND w > 0")
    shifted = base.withColumn("x0", F.lit(float(near))) if near is not None else base.join(base.groupBy(*by).agg(F.min("x").alias("x0")), by)
    moved = shifted.withColumn("d", F.col("x") - F.col("x0"))
    s = moved.groupBy(*by).agg(F.first("x0").alias("x0"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"), F.sum(F.col("w") * F.col("d")).alias("swd"), F.sum(F.col("w") * F.col("d") * F.col("d")).alias("swd2"), F.count("*").alias("n"))
    var = F.greatest(F.lit(0.0), F.col("swd2") / F.col("sw") - F.pow(F.col("swd") / F.col("sw"), 2))
    return s.select(
        *by, "n", F.col("sw").alias("sum_w"), (F.col("x0") + F.col("swd") / F.col("sw")).alias("mean"), var.alias("var_uncorrected"),
        (var / F.nullif(1 - F.col("sw2") / (F.col("sw") * F.col("sw")), F.lit(0.0))).alias("var_analytic"),
        (var * F.col("sw") / F.nullif(F.when(F.col("sw") > 1, F.col("sw") - 1).otherwise(0.0), F.lit(0.0))).alias("var_frequency"),
    )


def weighted_histogram(rows: DataFrame, code: str, weight: Column, by: list[str], bins: int = 17) -> DataFrame:
    """Summed weight of each code 0 .. bins - 1 in each group; codes that a group lacks count 0, other codes are left out.

    One pass: the sums of a group's codes are one row, spread over the codes afterwards.
    """
    c = F.col(code).cast("int")
    wide = rows.groupBy(*by).agg(F.array(*(F.coalesce(F.sum(F.when(c == k, weight)), F.lit(0.0)) for k in range(bins))).alias("__a"))
    return wide.select(*by, F.posexplode("__a").alias("code", "area"))


def event_days(cube: DataFrame, code: str = "event", by=("ilon", "ilat", "year")) -> DataFrame:
    """(by, kind, days): days with each bit and with hot and dry at once."""
    c = F.col(code)
    flags = {"h": bit(c, 1), "d30": bit(c, 2), "d90": bit(c, 4), "d180": bit(c, 8), "dh": (c > 1) & (c % 2 == 1)}
    wide = cube.groupBy(*by).agg(*(F.sum(f.cast("long")).alias(n) for n, f in flags.items()))
    return wide.unpivot(list(by), list(flags), "kind", "days")


def listed_label(cells: DataFrame, listed: DataFrame, out: str, label: str = "label", by=("ilon", "ilat")) -> DataFrame:
    """11 - i for the first listed label (label, i) that a cell has; 0 where it has none."""
    hits = cells.join(listed, label, "left").groupBy(*by).agg(F.min("i").alias("i"))
    return hits.select(*by, F.coalesce(11 - F.col("i"), F.lit(0)).alias(out))


_REDUCE = {"sum": lambda v, o: F.sum(v), "max": lambda v, o: F.max(v), "min": lambda v, o: F.min(v), "mean": lambda v, o: F.avg(v), "first": F.min_by}


def collapse(cube: DataFrame, value: str, keep: list[str], how: str, order: str = "time") -> DataFrame:
    """Reduce all axes but ``keep`` by sum, max, min, mean, first or mode (the last without zeros)."""
    if how == "mode":
        return mode_nonzero(cube, value, order, keep).withColumnRenamed("mode", value)
    return cube.groupBy(*keep).agg(_REDUCE[how](value, order).alias(value))


def collapse_all(cube: DataFrame, value: str, keep: list[str], how: list[str], order: str = "time") -> DataFrame:
    """(keep, how, value): several reductions in one pass."""
    wide = cube.groupBy(*keep).agg(*(_REDUCE[h](value, order).cast("double").alias(f"__{h}") for h in how))
    return wide.unpivot(keep, [f"__{h}" for h in how], "how", "value").withColumn("how", F.substring("how", 3, 99))


def histogram_2d(rows: DataFrame, x: Column, y: Column, dx: float, dy: float) -> DataFrame:
    return rows.where(x.isNotNull() & y.isNotNull()).groupBy(F.floor(x / dx).alias("bx"), F.floor(y / dy).alias("by_")).agg(F.count("*").alias("n"))


def hexagon(x: Column, y: Column, dx: float, dy: float) -> Column:
    """Centre (cx, cy) of the hexagon of width ``dx`` and height ``dy`` that holds (x, y); the first stands on 0, 0.

    The centres are two rectangular lattices, one moved by half a width and by half of its row distance of 1.5 heights;
    a point belongs to the nearer of the two centres next to it, to the unmoved one when both are as near.
    """
    u, v = x / dx, y / dy
    au, av = F.floor(u + 0.5), F.floor(v / 1.5 + 0.5) * 1.5
    bu, bv = F.floor(u) + 0.5, F.floor(v / 1.5) * 1.5 + 0.75
    away = lambda cu, cv: (u - cu) * (u - cu) + (v - cv) * (v - cv) * (4.0 / 3.0)  # noqa: E731 - a regular hexagon is 2 / sqrt(3) high
    first = away(au, av) <= away(bu, bv)
    return F.struct((F.when(first, au).otherwise(bu) * dx).alias("cx"), (F.when(first, av).otherwise(bv) * dy).alias("cy"))


def histogram_hexagons(rows: DataFrame, x: Column, y: Column, dx: float, dy: float) -> DataFrame:
    """(cx, cy, n): rows in each hexagon that has any; rows without x or y are left out."""
    placed = rows.select(known(x.cast("double")).alias("x"), known(y.cast("double")).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return placed.select(hexagon(F.col("x"), F.col("y"), dx, dy).alias("h")).groupBy("h.cx", "h.cy").agg(F.count("*").alias("n"))


def rounded_columns(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column at a fixed number of decimals, for comparison across engines."""
    return df.select(*(rounded(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def unit_rules(rows: DataFrame, variable: str = "variable", stat: str = "stat", value: str = "value") -> DataFrame:
    """Values of a long table in the units of reports: temperatures in degrees C (their variances stay), rain in mm.

    Rain comes in m, so its means are times 1e3 and its variances times 1e6.
    """
    v, k, variance = F.col(value), F.col(variable), F.col(stat) == "var"
    rain = F.when(variance, v * 1e6).otherwise(v * 1e3)
    return rows.withColumn(value, F.when(k == "tp", rain).when(k.startswith("t2m") & ~variance, v - 273.15).otherwise(v))
