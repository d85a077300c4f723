"""Tables partitioned by year that grow: which years are there, and replacing some of them in one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacube.sources.workspace import Workspace, place


def stored_years(spark: SparkSession, path: str) -> list[int]:
    """The years of the table, from the names of its folders; no file is opened."""
    fs, where = place(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n.removeprefix("year=")) for n in names if n.startswith("year="))


def replace_years(rows: DataFrame, path: str, order: list[str]) -> None:
    """Overwrite the years that ``rows`` holds, in one commit; other years stay as they are.

    ``rows`` must not be read from ``path`` itself: what stays of a year is staged in a written table first.  Files are
    sorted by ``order``, and a year is spread over as many of them as its rows need.
    """
    ready = rows.repartitionByRange("year", *order).sortWithinPartitions("year", *order)
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year").parquet(path)


def extend_years(kept: DataFrame | None, new: DataFrame, path: str, order: list[str], ws: Workspace) -> None:
    """Write ``new`` and the rows ``kept`` of years that change with it; both are staged before anything is replaced."""
    staged = ws.save(new if kept is None else kept.select(*new.columns).unionByName(new), "staged")
    replace_years(staged, path, order)


def in_years(table: DataFrame, years: list[int]) -> DataFrame:
    return table.where(F.col("year").isin(years))
