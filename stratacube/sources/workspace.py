"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage and survives the loss of an executor; iterative and
multi-pass operators go through it instead of caching.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder of our own in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Workspace:
    """A fresh folder for one operator call; tables in it are Parquet."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and return it as read back."""
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.path}/{name}")
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no plan still in use refers to."""
        for name in names:
            fs, path = place(self.spark, f"{self.path}/{name}")
            fs.delete(path, True)


def place(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def written(spark: SparkSession, where: str) -> bool:
    """Whether a table has been written there to its end."""
    fs, path = place(spark, f"{where}/_SUCCESS")
    return fs.exists(path)


_stored: dict[tuple, str] = {}


def stored(spark: SparkSession, name: str, sources: list[DataFrame], build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that several jobs of a session share, written once for each state of the files it is made from.

    A table that has gone from the shared folder since is built again.
    """
    state = tuple((*sorted(s.inputFiles()), str(s.select(F.max("_metadata.file_modification_time")).first()[0])) for s in sources)
    key = (spark.sparkContext.applicationId, name, state)
    if key not in _stored or not written(spark, _stored[key]):
        ws = Workspace(spark, name)
        ws.save(build(), "table")
        _stored[key] = f"{ws.path}/table"
    return spark.read.parquet(_stored[key])
