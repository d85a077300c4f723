"""Chunked array stores: round trips, only the chunks of a box, region updates, files of other writers."""

import datetime
import gzip
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacube.sources import chunked

FIRST = datetime.date(2001, 1, 1)
DAYS = [FIRST + datetime.timedelta(n) for n in range(25)]


def cube(spark):
    rows = [(x, 10.0 * y - 20, DAYS[t], None if (x + y + t) % 7 == 0 else float(x * 100 + y * 30 + t), float(t)) for x in range(7) for y in range(5) for t in range(25)]
    return spark.createDataFrame(rows, "ilon int, lat double, time date, a double, b float").repartition(3)


def stored(spark, path, compressor=None):
    chunked.create_store(path, {"ilon": np.arange(7, dtype="<i4"), "lat": [10.0 * y - 20 for y in range(5)], "time": DAYS}, {"a": "<f8", "b": "<f4"}, {"ilon": 3, "lat": 2, "time": 10}, compressor)
    chunked.write_store(cube(spark), path)


def rows(df):
    return sorted(map(tuple, df.select("ilon", "lat", "time", "a", "b").collect()), key=str)


@pytest.mark.parametrize("compressor", [None, {"id": "zlib", "level": 4}, {"id": "zstd", "level": 1}])
def test_round_trip(spark, tmp_path, compressor):
    path = f"file://{tmp_path}/store"
    stored(spark, path, compressor)
    got = chunked.read_store(spark, path)
    assert got.dtypes == [("ilon", "int"), ("lat", "double"), ("time", "date"), ("a", "double"), ("b", "float")]
    assert rows(got) == rows(cube(spark))
    assert got.rdd.getNumPartitions() == 27
    only = chunked.read_store(spark, path, "a")
    assert only.columns == ["ilon", "lat", "time", "a"] and only.count() == cube(spark).where("a IS NOT NULL").count()
    assert not [f for f in os.listdir(tmp_path / "store") if f.startswith(".staging")]


def test_a_box_opens_its_chunks_only(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    stored(spark, path)
    for f in list((tmp_path / "store").glob("[ab]/*.*.*")):
        if not f.name.startswith("1.") or not f.name.endswith(".1"):
            f.write_bytes(b"not a chunk")  # opening it would fail
    box = "ilon = 4 AND lat >= -20 AND lat < 30 AND time >= date'2001-01-12' AND time <= date'2001-01-15'"
    got = chunked.read_store(spark, path).where(box)
    assert rows(got) == rows(cube(spark).where(box)) and got.count() == 20
    assert got.rdd.getNumPartitions() == 3
    assert chunked.read_store(spark, path).where("time > date'2030-01-01'").count() == 0
    with pytest.raises(Exception, match="reshape|buffer|cannot"):
        chunked.read_store(spark, path).collect()


def test_a_region_is_updated_in_place(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    stored(spark, path, {"id": "zlib"})
    patch = cube(spark).where("ilon BETWEEN 2 AND 3 AND time = date'2001-01-05'").withColumns({"a": F.lit(-1.0), "b": F.lit(-2.0).cast("float")})
    chunked.write_store(patch, path)
    want = cube(spark).withColumns({c: F.when(F.col("ilon").between(2, 3) & (F.col("time") == F.lit("2001-01-05").cast("date")), v).otherwise(F.col(c)).cast(t) for c, v, t in (("a", -1.0, "double"), ("b", -2.0, "float"))})
    assert rows(chunked.read_store(spark, path)) == rows(want)
    before = rows(chunked.read_store(spark, path))
    with pytest.raises(Exception, match="no such place on axis lat"):
        chunked.write_store(patch.withColumn("lat", F.col("lat") + 1), path)
    assert rows(chunked.read_store(spark, path)) == before and not [f for f in os.listdir(tmp_path / "store") if f.startswith(".staging")]


def test_a_chunk_by_two_tasks_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    stored(spark, path)
    loose = cube(spark).where("ilon = 0").select(F.col("ilon").alias("__ilon"), F.lit(0).alias("__lat"), (F.dayofyear("time") - 1).alias("__time"), "a", "b").repartition(2)
    with pytest.raises(Exception, match="two tasks"):
        loose.write.format(chunked.FORMAT).mode("append").save(path)
    assert rows(chunked.read_store(spark, path)) == rows(cube(spark))


def test_files_of_another_writer(spark, tmp_path):
    """Packed by hand after the public description: another epoch, gzip, a missing chunk, a ragged last chunk."""
    root = tmp_path / "other"
    for name, shape, chunks, dtype, dims, attrs, data in (("time", [3], [2], "<i4", ["time"], {"units": "days since 2000-01-01 00:00:00"}, {"0": [0, 1], "1": [2, 0]}), ("x", [2], [2], "<f4", ["x"], {}, {"0": [0.5, 1.5]}), ("v", [3, 2], [2, 2], "<i2", ["time", "x"], {}, {"1.0": [[5, 6], [0, 0]]})):
        (root / name).mkdir(parents=True)
        (root / name / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": dtype, "fill_value": 9, "compressor": {"id": "gzip", "level": 1}, "filters": None, "order": "C"}))
        (root / name / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims} | attrs))
        for key, values in data.items():
            (root / name / key).write_bytes(gzip.compress(np.array(values, dtype=dtype).tobytes()))
    got = sorted(map(tuple, chunked.read_store(spark, str(root)).collect()))
    d = lambda n: datetime.date(2000, 1, n)
    assert got == [(d(1), 0.5, 9), (d(1), 1.5, 9), (d(2), 0.5, 9), (d(2), 1.5, 9), (d(3), 0.5, 5), (d(3), 1.5, 6)]
    (root / "v" / ".zarray").write_text((root / "v" / ".zarray").read_text().replace("gzip", "blosc"))
    with pytest.raises(Exception, match="blosc"):
        chunked.read_store(spark, str(root)).collect()
