"""Hourly stream to daily cube: event-time days under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacube.sources.workspace import Workspace


def daily_from_stream(spark: SparkSession, source: str, late: str = "2 days") -> DataFrame:
    """Sum the event stream by cell and day; a day is written once the watermark has passed it.

    The source is read to its present end and the days written are returned.  Since no later event closes the last
    days, those still open at the end are summed by a batch over the same source and added.  Rows that come later than
    ``late`` are left out of the days that the stream has closed, and are in those that the batch adds.
    """
    ws = Workspace(spark, "stream")
    folder, _, name = source.rpartition("/")
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{folder}/{name[:-8]}[.]parquet" if name.endswith(".parquet") else source)
    cells = lambda df: df.select((F.col("user_id") % 10).cast("int").alias("ilon"), F.lit(0).alias("ilat"), F.col("ts").cast("timestamp").alias("ts"), "value")
    days = cells(stream).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "ilon", "ilat").agg(F.sum("value").alias("tp"), F.count("*").alias("n"))
    out = days.select("ilon", "ilat", F.to_date("window.start").alias("time"), "tp", "n")
    run = out.writeStream.format("parquet").outputMode("append").option("path", f"{ws.path}/days").option("checkpointLocation", f"{ws.path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    closed = spark.read.schema(out.schema).parquet(f"{ws.path}/days")
    batch = cells(spark.read.parquet(source)).groupBy("ilon", "ilat", F.to_date("ts").alias("time")).agg(F.sum("value").alias("tp"), F.count("*").alias("n"))
    return closed.unionByName(batch.join(closed.select("time").distinct(), "time", "left_anti").select(*closed.columns))
