"""Layers of one cube stored in the same layout, so that they are joined where they lie.

Every layer is a table dealt into the same number of buckets by cell.  Windows along time and joins of any number of
layers by cell and day then need no exchange: bucket meets bucket.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from stratacube.sources.workspace import shared_dir

#: Spark deals both sides of a join anew unless they are dealt by all of its keys; layers are dealt by cell, joined by cell and day.
PARTIAL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


class CubeLayout:
    """Layer tables of one cube in ``buckets`` buckets by ``cell``, in a folder of the shared workspace unless one is named.

    Joins of layers need the session's ``spark.sql.requireAllClusterKeysForCoPartition`` to be false, which is set here.
    """

    def __init__(self, spark: SparkSession, buckets: int, path: str | None = None, cell: tuple[str, ...] = ("ilon", "ilat"), time: str = "time"):
        self.spark, self.buckets, self.cell, self.time = spark, buckets, cell, time
        self.name = f"cube_{uuid.uuid4().hex[:12]}"
        self.path = path or f"{shared_dir(spark)}/{self.name}"
        self.layers: dict[str, str] = {}
        spark.conf.set(PARTIAL_KEYS, "false")

    def add(self, name: str, layer: DataFrame, dealt: bool = False) -> DataFrame:
        """Store ``layer`` under ``name`` and return it as read back; ``dealt`` layers come from this layout by windows and joins and lie right already."""
        ready = layer if dealt else layer.repartition(self.buckets, *self.cell)
        order = [*self.cell, *([self.time] if self.time in layer.columns else [])]
        table = f"{self.name}_{name}"
        ready.write.mode("overwrite").format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}").bucketBy(self.buckets, *self.cell).sortBy(*order).saveAsTable(table)
        self.layers[name] = table
        return self.spark.table(table)

    def joined(self, *names: str) -> DataFrame:
        """The named layers, all by default, joined by cell and day, or by cell where a layer has no days; rows that all of them have."""
        tables = [self.spark.table(self.layers[n]) for n in (names or self.layers)]
        static = lambda t: self.time not in t.columns
        tables.sort(key=static)
        keys = lambda t: [*self.cell] if static(t) else [*self.cell, self.time]
        # merged bucket by bucket, whatever the size of a layer
        return reduce(lambda a, b: a.join(b.hint("merge"), keys(b)), tables)

    def drop(self) -> None:
        """Forget the tables; their files stay until the folder is removed."""
        for table in self.layers.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.layers.clear()
