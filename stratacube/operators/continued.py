"""Running means and ranks that go on when days are appended, from what is stored of each cell and the new days alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacube.operators.windows import CELL, running_mean
from stratacube.sources.workspace import Workspace, place
from stratacube.sources.years import extend_years, in_years, stored_years


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the written versions v1, v2, ... at ``path``; a version counts once its write has ended."""
    fs, where = place(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(place(spark, f"{path}/{n}/_SUCCESS")[1]))


class RunningMeans:
    """Trailing means of ``value`` over several widths, by year at ``path``/days, with each cell's last rows at ``path``/tail.

    Appending reads the tail, one row less than the widest frame for each cell, never the days before.
    """

    def __init__(self, spark: SparkSession, path: str, value: str, widths: dict[str, int]):
        self.spark, self.path, self.value, self.widths = spark, path, value, widths

    def days(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/days")

    def tail(self) -> DataFrame | None:
        found = _versions(self.spark, f"{self.path}/tail")
        return self.spark.read.parquet(f"{self.path}/tail/v{found[-1]}") if found else None

    def append(self, days: DataFrame) -> None:
        """Add days (ilon, ilat, time, value), each later than the cell's stored ones; earlier ones are an error."""
        ws = Workspace(self.spark, "running")
        new = days.select(*CELL, "time", self.value, F.lit(True).alias("__new"))
        tail = self.tail()
        both = new if tail is None else tail.select(*CELL, "time", self.value, F.lit(False).alias("__new")).unionByName(new)
        for out, width in self.widths.items():
            both = running_mean(both, F.col(self.value), width, out)
        late = F.raise_error(F.lit("a day is not later than the stored days of its cell")).cast("boolean")
        stored = F.max(F.when(~F.col("__new"), F.col("time"))).over(Window.partitionBy(*CELL))
        both = both.withColumns({"__new": F.when(F.col("__new") & (stored >= F.col("time")), late).otherwise(F.col("__new")), "__last": F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc("time")))})
        both = ws.save(both, "both")
        fresh = both.where("__new").drop("__new", "__last").withColumn("year", F.year("time"))
        there = stored_years(self.spark, f"{self.path}/days")
        again = sorted({r["year"] for r in fresh.select("year").distinct().collect()} & set(there))  # a year that goes on
        extend_years(in_years(self.days(), again) if again else None, fresh, f"{self.path}/days", [*reversed(CELL), "time"], ws)
        version = (_versions(self.spark, f"{self.path}/tail") or [0])[-1] + 1
        kept = both.where(F.col("__last") < max(self.widths.values())).select(*CELL, "time", self.value)
        kept.write.mode("overwrite").parquet(f"{self.path}/tail/v{version}")


def _sort_keys(values: pa.ChunkedArray) -> np.ndarray:
    """Numbers in order, then NaN, then null: (0, 1 or 2, value) as complex numbers, which are compared part by part."""
    x = values.fill_null(0.0).to_numpy()
    nan, null = np.isnan(x), values.is_null().to_numpy()
    keys = np.zeros(len(x), dtype=np.complex128)
    keys.real, keys.imag = np.where(null, 2, nan), np.where(nan | null, 0.0, x)
    return keys


class Ranks:
    """Rank of every day among the days of its cell, as ``windows.rank_transform`` gives it, kept up as days are added.

    A version (ilon, ilat, time, value, place) is a whole table, since every place may move; but no history is sorted
    again: the new days of a cell are put in order and merged into the stored order, which is read off the places.
    """

    def __init__(self, spark: SparkSession, path: str, value: str):
        self.spark, self.path, self.value = spark, path, value

    def places(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{_versions(self.spark, self.path)[-1]}")

    def append(self, days: DataFrame) -> None:
        """Add days (ilon, ilat, time, value), each later than the cell's stored ones; earlier ones are an error.

        Equal values are ranked by time, NaN and null values come last.
        """
        found = _versions(self.spark, self.path)
        new = days.select(*CELL, "time", F.col(self.value).cast("double").alias(self.value))
        old = self.places() if found else new.limit(0).withColumn("place", F.lit(0).cast("long"))
        value, names = self.value, list(old.columns)

        def merge(stored: pa.Table, added: pa.Table) -> pa.Table:
            added = added.sort_by("time")
            if len(stored) and len(added) and added["time"][0].as_py() <= pc.max(stored["time"]).as_py():
                raise ValueError("a day is not later than the stored days of its cell")
            add, mine = _sort_keys(added[value]), _sort_keys(stored[value])
            by = np.argsort(add, kind="stable")
            at = stored["place"].to_numpy() - 1
            ordered = np.empty_like(mine)
            ordered[at] = mine
            places = np.empty(len(add), dtype=np.int64)
            places[by] = np.arange(1, len(add) + 1) + np.searchsorted(ordered, add[by], side="right")
            moved = at + 1 + np.searchsorted(add[by], mine, side="left")
            both = [stored.set_column(names.index("place"), "place", pa.array(moved)), added.append_column("place", pa.array(places))]
            return pa.concat_tables([t.select(names) for t in both])

        merged = old.groupBy(*CELL).cogroup(new.groupBy(*CELL)).applyInArrow(merge, old.schema)
        merged.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/v{(found or [0])[-1] + 1}")

    def ranks(self, out: str) -> DataFrame:
        """(ilon, ilat, time, value, out): place / number of days of the cell."""
        n = F.count(F.lit(1)).over(Window.partitionBy(*CELL))
        return self.places().withColumn(out, F.col("place") / n).drop("place")
