"""Chunked array stores (the public Zarr layout, version 2) as a Spark source and sink.

A store is a folder with an array for each variable, an array for each axis, and small JSON files that describe them; an
array is a file for each chunk.  Reading makes one partition of each chunk that meets the filters on coordinates; no other
chunk is opened.  Writing deals the rows by chunk, stages every chunk beside the store and moves the staged files into
place once all tasks have ended, so a lost or repeated task leaves nothing behind.
"""

from __future__ import annotations

import itertools
import json
import math
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

FORMAT = "chunked_array"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
DAYS = "days since 1970-01-01"
#: Rows of one batch that a chunk is handed on in.
BATCH_ROWS = 1 << 17


class Store:
    """Files of a store; ``path`` is a local path or a URI that the file systems of Arrow know."""

    def __init__(self, path: str):
        self.path = path
        self.fs, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")

    def read(self, name: str) -> bytes | None:
        info = self.fs.get_file_info(f"{self.root}/{name}")
        if info.type == fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return f.read()

    def write(self, name: str, data: bytes) -> None:
        self.fs.create_dir(f"{self.root}/{name}".rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(f"{self.root}/{name}") as f:
            f.write(data)

    def move(self, name: str, to: str) -> None:
        if isinstance(self.fs, fs.LocalFileSystem) or self.fs.get_file_info(f"{self.root}/{to}").type == fs.FileType.NotFound:
            self.fs.move(f"{self.root}/{name}", f"{self.root}/{to}")
        else:  # not every file system moves onto a file
            self.fs.delete_file(f"{self.root}/{to}")
            self.fs.move(f"{self.root}/{name}", f"{self.root}/{to}")

    def drop(self, name: str, tries: int = 5) -> None:
        """Delete a folder; tasks of a job that has failed may still be writing to it for a moment."""
        for k in range(tries):
            try:
                if self.fs.get_file_info(f"{self.root}/{name}").type == fs.FileType.Directory:
                    self.fs.delete_dir(f"{self.root}/{name}")
                return
            except OSError:
                if k == tries - 1:
                    raise
                time.sleep(1)

    def arrays(self) -> dict[str, Array]:
        names = [i.base_name for i in self.fs.get_file_info(fs.FileSelector(self.root)) if i.type == fs.FileType.Directory and not i.base_name.startswith(".")]
        return {n: Array.of(self, n) for n in sorted(names)}


@dataclass
class Array:
    name: str
    shape: list[int]
    chunks: list[int]
    dtype: np.dtype
    fill: float | int | None
    compressor: dict | None
    dims: list[str]
    attrs: dict

    @classmethod
    def of(cls, store: Store, name: str) -> Array:
        meta, attrs = json.loads(store.read(f"{name}/.zarray")), json.loads(store.read(f"{name}/.zattrs") or b"{}")
        if meta["zarr_format"] != 2 or meta["order"] != "C" or meta.get("filters"):
            raise ValueError(f"array {name}: only version 2, row order and no filters are read")
        fill = {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}.get(meta["fill_value"], meta["fill_value"])
        return cls(name, meta["shape"], meta["chunks"], np.dtype(meta["dtype"]), fill, meta["compressor"], attrs.get("_ARRAY_DIMENSIONS", [name]), attrs)

    def describe(self, store: Store) -> None:
        fill = "NaN" if isinstance(self.fill, float) and math.isnan(self.fill) else self.fill
        meta = {"zarr_format": 2, "shape": self.shape, "chunks": self.chunks, "dtype": self.dtype.str, "fill_value": fill, "compressor": self.compressor, "filters": None, "order": "C"}
        store.write(f"{self.name}/.zarray", json.dumps(meta).encode())
        store.write(f"{self.name}/.zattrs", json.dumps(self.attrs | {"_ARRAY_DIMENSIONS": self.dims}).encode())

    def encode(self, values: np.ndarray) -> bytes:
        raw = np.ascontiguousarray(values, dtype=self.dtype).tobytes()
        kind = self.compressor and self.compressor["id"]
        if kind is None:
            return raw
        if kind == "zlib":
            return zlib.compress(raw, self.compressor.get("level", 1))
        if kind == "zstd":
            return pa.Codec("zstd").compress(raw, asbytes=True)
        raise ValueError(f"array {self.name}: no way to write {kind}")

    def chunk(self, store: Store, index: tuple[int, ...]) -> np.ndarray:
        """Values of a chunk as far as the array reaches; the fill value where no file is."""
        raw = store.read(f"{self.name}/{'.'.join(map(str, index))}")
        room = [min(c, s - i * c) for i, c, s in zip(index, self.chunks, self.shape, strict=True)]
        if raw is None:
            return np.full(room, self.fill if self.fill is not None else 0, dtype=self.dtype)
        kind, size = self.compressor and self.compressor["id"], math.prod(self.chunks) * self.dtype.itemsize
        if kind in ("zlib", "gzip"):
            raw = zlib.decompress(raw, zlib.MAX_WBITS | 32)
        elif kind == "zstd":
            raw = pa.Codec("zstd").decompress(raw, size, asbytes=True)
        elif kind is not None:
            raise ValueError(f"array {self.name}: no way to read {kind}")
        return np.frombuffer(raw, dtype=self.dtype).reshape(self.chunks)[tuple(slice(n) for n in room)]

    def whole(self, store: Store) -> np.ndarray:
        """All values of an axis."""
        return np.concatenate([self.chunk(store, (i,)) for i in range(-(-self.shape[0] // self.chunks[0]))])

    def spark_type(self) -> str:
        if str(self.attrs.get("units", "")).startswith("days since"):
            return "date"
        return {"f8": "double", "f4": "float", "i8": "long", "i4": "int", "i2": "short", "i1": "byte", "u1": "short"}[self.dtype.str[1:]]

    def coordinates(self, store: Store) -> np.ndarray:
        """Values of an axis as Spark compares them; days count from 1970."""
        values = self.whole(store)
        if self.spark_type() == "date":
            since = np.datetime64(str(self.attrs["units"]).removeprefix("days since ")[:10], "D")
            return values.astype(np.int64) + since.astype(np.int64)
        return values


def create_store(path: str, axes: dict[str, list], variables: dict[str, str], chunks: dict[str, int], compressor: dict | None = None) -> None:
    """The skeleton of a store: axes with all their coordinates, variables (name -> type like '<f8') without a chunk."""
    store = Store(path)
    store.write(".zgroup", b'{"zarr_format": 2}')
    for name, values in axes.items():
        days = hasattr(values[0], "isoformat")
        data = np.array(values, dtype="datetime64[D]").astype("<i8") if days else np.asarray(values)
        axis = Array(name, [len(data)], [max(1, len(data))], data.dtype.newbyteorder("<"), None, None, [name], {"units": DAYS} if days else {})
        axis.describe(store)
        store.write(f"{name}/0", axis.encode(data))
    for name, kind in variables.items():
        dtype = np.dtype(kind)
        Array(name, [len(v) for v in axes.values()], [chunks[a] for a in axes], dtype, math.nan if dtype.kind == "f" else 0, compressor, list(axes), {}).describe(store)


@dataclass
class _Chunk(InputPartition):
    index: tuple[int, ...]


def _day(value) -> int | float:
    return (value - type(value)(1970, 1, 1)).days if hasattr(value, "isoformat") else value


class _Reader(DataSourceReader):
    def __init__(self, path: str, wanted: list[str]):
        self.path, self.wanted, self.ranges = path, wanted, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        """Ranges of coordinates choose chunks; Spark still applies every filter to the rows."""
        axes = {a for n in self.wanted for a in Array.of(Store(self.path), n).dims}
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute[0] in axes:
                low, high = self.ranges.get(f.attribute[0], (-math.inf, math.inf))
                v = _day(f.value)
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    low = max(low, v)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    high = min(high, v)
                self.ranges[f.attribute[0]] = low, high
            yield f

    def partitions(self) -> list[_Chunk]:
        store = Store(self.path)
        first = Array.of(store, self.wanted[0])
        sides = []
        for axis, chunk in zip(first.dims, first.chunks, strict=True):
            values = Array.of(store, axis).coordinates(store)
            low, high = self.ranges.get(axis, (-math.inf, math.inf))
            sides.append(np.unique(np.flatnonzero((values >= low) & (values <= high)) // chunk).tolist())
        return [_Chunk(i) for i in itertools.product(*sides)]

    def read(self, partition: _Chunk | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no chunk meets the filters
            return
        store = Store(self.path)
        arrays = [Array.of(store, n) for n in self.wanted]
        axes = [Array.of(store, a) for a in arrays[0].dims]
        values = [a.chunk(store, partition.index) for a in arrays]
        known = reduce(np.logical_or, [~np.isnan(v) if v.dtype.kind == "f" else np.ones(v.shape, bool) for v in values])
        places = np.nonzero(known)
        for a in range(0, len(places[0]), BATCH_ROWS):
            part = tuple(p[a : a + BATCH_ROWS] for p in places)
            columns, names = [], []
            for axis, i, chunk, p in zip(axes, partition.index, arrays[0].chunks, part, strict=True):
                held = axis.coordinates(store)[i * chunk + p]
                columns.append(pa.array(held.astype(np.int32), pa.int32()).cast(pa.date32()) if axis.spark_type() == "date" else pa.array(held))
                names.append(axis.name)
            for array, v in zip(arrays, values, strict=True):
                taken = v[part]
                columns.append(pa.array(taken, mask=np.isnan(taken) if taken.dtype.kind == "f" else None))
                names.append(array.name)
            yield pa.RecordBatch.from_arrays(columns, names)


@dataclass
class _Staged(WriterCommitMessage):
    folder: str
    keys: list[str]


class _Writer(DataSourceArrowWriter):
    """Rows (place along each axis, values) of whole chunks, chunk after chunk; a chunk that is there is filled up."""

    def __init__(self, path: str, variables: list[str]):
        self.path, self.variables, self.job = path, variables, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Staged:
        store = Store(self.path)
        arrays = [Array.of(store, n) for n in self.variables]
        dims, chunks = arrays[0].dims, np.array(arrays[0].chunks)
        staged = _Staged(f".staging-{self.job}/{uuid.uuid4().hex}", [])
        held: tuple | None = None
        blocks: list[np.ndarray] = []

        def flush() -> None:
            for array, block in zip(arrays, blocks, strict=True):
                key = f"{array.name}/{'.'.join(map(str, held))}"
                full = np.full(array.chunks, array.fill if array.fill is not None else 0, dtype=array.dtype)
                full[tuple(slice(n) for n in block.shape)] = block
                store.write(f"{staged.folder}/{key}", array.encode(full))
                staged.keys.append(key)

        for batch in iterator:
            at = np.stack([batch.column(f"__{d}").to_numpy() for d in dims])
            index = at // chunks[:, None]
            edges = np.flatnonzero(np.r_[True, (index[:, 1:] != index[:, :-1]).any(axis=0), True]) if batch.num_rows else []
            for a, b in itertools.pairwise(edges):
                now = tuple(index[:, a].tolist())
                if now != held:
                    if held is not None:
                        flush()
                    held, blocks = now, [x.chunk(store, now).copy() for x in arrays]
                places = tuple(at[k, a:b] - now[k] * chunks[k] for k in range(len(dims)))
                for array, block in zip(arrays, blocks, strict=True):
                    block[places] = batch.column(array.name).slice(a, b - a).to_numpy(zero_copy_only=False)
        if held is not None:
            flush()
        return staged

    def commit(self, messages: list[_Staged | None]) -> None:
        store = Store(self.path)
        keys = [k for m in messages if m for k in m.keys]
        if len(set(keys)) < len(keys):
            self.abort(messages)
            raise ValueError("a chunk was written by two tasks; deal the rows by chunk")
        for m in messages:
            for k in m.keys if m else []:
                store.move(f"{m.folder}/{k}", k)
        store.drop(f".staging-{self.job}")

    def abort(self, messages: list[_Staged | None]) -> None:
        Store(self.path).drop(f".staging-{self.job}")


class ChunkedArrays(DataSource):
    """``spark.read.format("chunked_array").option("variables", "a,b").load(path)``; all variables of one shape by default.

    Rows are the places where some variable has a value: coordinates, then values, NaN as null.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _wanted(self) -> list[str]:
        arrays = Store(self.options["path"]).arrays()
        named = self.options.get("variables", "")
        found = [n.strip() for n in named.split(",")] if named else [n for n, a in arrays.items() if a.dims != [n]]
        if not found or len({(tuple(arrays[n].dims), tuple(arrays[n].chunks)) for n in found}) > 1:
            raise ValueError(f"variables {found} do not share axes and chunks; name some that do")
        return found

    def schema(self) -> str:
        arrays, wanted = Store(self.options["path"]).arrays(), self._wanted()
        return ", ".join(f"`{n}` {arrays[n].spark_type()}" for n in [*arrays[wanted[0]].dims, *wanted])

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self._wanted())

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], [f.name for f in schema if not f.name.startswith("__")])


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and filters known to it."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(ChunkedArrays)


def read_store(spark: SparkSession, path: str, *variables: str) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("variables", ",".join(variables)).load(path)


def write_store(rows: DataFrame, path: str) -> None:
    """Put ``rows`` (axes and variables) into the store at ``path``; places that it does not name keep what they hold.

    A coordinate that is not on its axis fails the job; of two rows for one place either stays.  Axes are broadcast: they
    are as long as a side of the cube.
    """
    spark = rows.sparkSession
    register(spark)
    store = Store(path)
    arrays = store.arrays()
    variables = [c for c in rows.columns if arrays[c].dims != [c]]
    first, placed = arrays[variables[0]], rows
    for d in first.dims:
        values = arrays[d].coordinates(store)
        kind = arrays[d].spark_type()
        table = spark.createDataFrame([(v, i) for i, v in enumerate(values.tolist())], f"v {'int' if kind == 'date' else kind}, i int")
        on = F.date_add(F.lit("1970-01-01").cast("date"), F.col("v")) if kind == "date" else F.col("v")
        table = table.select(on.alias(d), F.col("i").alias(f"__{d}"))
        off = F.raise_error(F.concat(F.lit(f"no such place on axis {d}: "), F.col(d).cast("string"))).cast("int")
        placed = placed.join(F.broadcast(table), d, "left").withColumn(f"__{d}", F.coalesce(f"__{d}", off))
    ids = [F.floor(F.col(f"__{d}") / c) for d, c in zip(first.dims, first.chunks, strict=True)]
    ready = placed.select(*(f"__{d}" for d in first.dims), *variables).repartition(*ids).sortWithinPartitions(*ids)
    ready.write.format(FORMAT).mode("append").save(path)
