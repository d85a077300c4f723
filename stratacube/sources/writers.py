"""Writing cubes: by year, sorted by cell, appended by day, replaced by period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_cube(cube: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by year; rows of a file are sorted by cell and day, so row groups prune on both."""
    ready = cube.withColumn("year", F.year("time"))
    ready.repartitionByRange("year", "ilat", "ilon").sortWithinPartitions("year", "ilat", "ilon", "time").write.mode(mode).partitionBy("year").parquet(path)


def append_days(spark: SparkSession, cube: DataFrame, path: str) -> None:
    """Append the days that the store does not hold yet."""
    have = spark.read.parquet(path).select("time").distinct()
    write_cube(cube.join(have, "time", "left_anti"), path, "append")


def add_layer(spark: SparkSession, layer: DataFrame, path: str, out: str) -> None:
    """The store at ``path`` with the columns of ``layer`` joined on cell and day, written to ``out``."""
    old = spark.read.parquet(path).drop("year")
    write_cube(old.join(layer, ["ilon", "ilat", "time"], "left"), out)


def replace_years(cube: DataFrame, path: str) -> None:
    """Overwrite only the years that ``cube`` holds."""
    ready = cube.withColumn("year", F.year("time"))
    ready.repartitionByRange("year", "ilat", "ilon").sortWithinPartitions("year", "ilat", "ilon", "time").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def with_metadata(cube: DataFrame, column: str, **properties) -> DataFrame:
    """Properties (long name, units, ...) attached to a layer; they travel in the schema."""
    return cube.withMetadata(column, {**cube.schema[column].metadata, **properties})


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True)


def latex_table(table: DataFrame, digits: int = 2) -> str:
    """A small report as a LaTeX tabular; the caller aggregates or limits first."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    rows = [" & ".join(show(v) for v in row) for row in table.collect()]
    head = " & ".join(c.replace("_", r"\_") for c in table.columns)
    return "\n".join([r"\begin{tabular}{" + "r" * len(table.columns) + "}", head + r" \\ \hline", *(x + r" \\" for x in rows), r"\end{tabular}"])
