"""Reading cubes and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def decode(raw: Column, scale: float = 1.0, offset: float = 0.0, missing: float | None = None) -> Column:
    """Packed values to measures; the ``missing`` code to null."""
    known = F.nullif(raw, F.lit(missing)) if missing is not None else raw
    return known * F.lit(float(scale)) + F.lit(float(offset))


def read_cube(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """One cube from any number of Parquet folders, each partitioned or not; only the named columns are read.

    Columns meet by name.  Every folder is a scan of its own, since partitions of several roots cannot be one table.
    """
    parts = [spark.read.parquet(p) for p in paths]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts] if columns else parts)


def one_file_per_month(names: DataFrame, suffix: str = ".parquet", drop: str = "back_extension", name: str = "path") -> DataFrame:
    """(year, month, path) of files named ...mm.yyyy<suffix>, without extensions backward; more than one per month is an error row."""
    good = names.where(F.col(name).endswith(suffix) & ~F.col(name).contains(drop))
    tail = F.regexp_extract(F.col(name), r"(\d{2}\.\d{4})" + suffix.replace(".", r"\.") + "$", 1)
    dated = good.withColumn("tail", tail).where("tail <> ''")
    grouped = dated.groupBy(F.substring("tail", 4, 4).cast("int").alias("year"), F.substring("tail", 1, 2).cast("int").alias("month")).agg(F.min(name).alias("path"), F.count("*").alias("files"))
    return grouped.withColumn("unique", F.col("files") == 1)


def read_event_list(spark: SparkSession, path: str, schema: str | StructType, preamble: int = 0) -> DataFrame:
    """CSV with ``preamble`` lines before its header; dates like 2003.08.01 are accepted in date columns.

    The preamble is recognised by line number within the file, so one small file is one task; lists are short.
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if preamble:
        numbered = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("k", "line"))
        lines = numbered.where((F.col("k") > preamble) & (F.length("line") > 0)).select("line")
        parsed = lines.select(F.from_csv("line", ", ".join(f"`{f.name}` string" for f in wanted)).alias("r")).select("r.*")
    else:
        parsed = spark.read.csv(path, header=True, schema=StructType.fromDDL(", ".join(f"`{f.name}` string" for f in wanted)))
    dash = lambda f: F.regexp_replace(f.name, r"\.", "-") if f.dataType.typeName() == "date" else F.col(f.name)
    return parsed.select(*(dash(f).try_cast(f.dataType).alias(f.name) for f in wanted))
