"""Cube views of the relational tables a deployment already has: order lines as a daily grid, events as hourly series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacube.operators.events import event_code
from stratacube.operators.indicators import water_balance
from stratacube.operators.windows import rank_transform, running_mean

NLON = NLAT = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 x 5 global grid, daily; one row per cell and day with data."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = line.join(supp, line.l_suppkey == supp.s_suppkey)
    daily = joined.groupBy("s_nationkey", F.to_date("l_shipdate").alias("time")).agg(
        (F.lit(273.15) + F.max("l_extendedprice") / 2500).alias("t2mmax"), (F.lit(273.15) + F.avg("l_extendedprice") / 2500).alias("t2m"),
        (F.lit(273.15) + F.min("l_extendedprice") / 2500).alias("t2mmin"), (F.sum("l_quantity") / 10000).alias("tp"),
        (-F.avg("l_extendedprice") / 10000).alias("pet"), F.count("*").alias("n_obs"),
    )
    ilon, ilat = (F.col("s_nationkey") % 5).cast("int"), F.floor(F.col("s_nationkey") / 5).cast("int")
    return daily.select(ilon.alias("ilon"), ilat.alias("ilat"), (ilon * 72.0).alias("lon"), (F.lit(60.0) - ilat * 30.0).alias("lat"), "time", "t2mmax", "t2m", "t2mmin", "tp", "pet", "n_obs")


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land share and continent of each cell; a dimension table of one row per cell."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select((n % 5).cast("int").alias("ilon"), F.floor(n / 5).cast("int").alias("ilat"), ((n % 4) / 3.0).alias("lsm"), F.when(n != 24, F.col("n_regionkey") + 1).alias("cont"))


def grid_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving water balances and their ranks per cell, with the rank of the heat (hottest lowest)."""
    cube = grid_daily(spark, sf_dir).withColumn("wb", water_balance(F.col("tp"), F.col("pet")))
    for width in (30, 90, 180):
        cube = running_mean(cube, F.col("wb"), width, f"pei_{width}")
    cube = rank_transform(cube, F.round(F.col("t2mmax"), 9), "rt", -1.0)
    for width in (30, 90, 180):
        cube = rank_transform(cube, F.round(F.col(f"pei_{width}"), 9), f"rd{width}")
    return cube


def grid_event(spark: SparkSession, sf_dir: str, threshold: float = 0.1, non_extreme: float = 0.1) -> DataFrame:
    cube = grid_ranks(spark, sf_dir)
    return cube.withColumn("event", event_code([F.col(c) for c in ("rt", "rd30", "rd90", "rd180")], threshold, non_extreme))


def dry_days(spark: SparkSession, sf_dir: str, limit: float = 0.3) -> DataFrame:
    return grid_ranks(spark, sf_dir).where(F.col("rd30") < limit).select("ilon", "ilat", "lon", "lat", "time", "t2mmax", "pei_30")


def period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.to_date(F.min("l_shipdate")).alias("first"), F.to_date(F.max("l_shipdate")).alias("last"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly series of ten cells from the event stream."""
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 10).cast("int").alias("ilon"), F.lit(0).alias("ilat"), F.date_trunc("hour", F.col("ts").cast("timestamp_ntz")).alias("ts")).agg(F.sum("value").alias("tp"), F.avg("value").alias("t2m"), F.count("*").alias("n"))


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten members over nine cells, daily."""
    e = table(spark, sf_dir, "events")
    c = F.col("user_id") % 9
    return e.select(F.concat(F.col("event_type"), (F.col("user_id") % 2).cast("string")).alias("member"), (c % 3).cast("int").alias("ilon"), F.floor(c / 3).cast("int").alias("ilat"), F.to_date("ts").alias("time"), (F.col("value") / 10).alias("v")).groupBy("member", "ilon", "ilat", "time").agg(F.avg("v").alias("v"))


def ref_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented events, one per nation: the twenty days from its largest order, over a box of the nation's place."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    largest = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("obs_event")).agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"), "day")).alias("m"))
    west = (F.col("obs_event") % 5) * 72.0 - 80.0
    north = F.lit(70.0) - F.floor(F.col("obs_event") / 5) * 30.0
    return largest.select("obs_event", F.col("m.day").alias("start"), F.date_add("m.day", 20).alias("end"), west.alias("west"), (west + 80.0).alias("east"), (north - 40.0).alias("south"), north.alias("north"))
