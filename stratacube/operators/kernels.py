"""A user's function over the axes it asks for, for every cell of the axes it leaves out, over one or several cubes.

The cubes are dealt by the axes that are looped over and meet in one shuffle, however many there are.  The function gets
numpy arrays in the order of its input axes and returns arrays along declared output axes, which are checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


@dataclass(frozen=True)
class Input:
    """A cube, the axes that the function sees of it (none for a layer with one row per cell), and its value columns."""

    cube: DataFrame
    axes: tuple[str, ...]
    values: tuple[str, ...]


@dataclass(frozen=True)
class Output:
    """Output axes and values with their Spark types; ``coords`` names all coordinates of an axis where they are known."""

    axes: dict[str, str]
    values: dict[str, str]
    coords: dict[str, Iterable] = field(default_factory=dict)


class Slab:
    """What the function sees of a cube in one cell: coordinates and values, in the order of the axes."""

    def __init__(self, axes: dict[str, np.ndarray], values: dict[str, np.ndarray]):
        self.axes, self.values = axes, values

    def __getitem__(self, name: str) -> np.ndarray:
        return self.values[name] if name in self.values else self.axes[name]

    def __len__(self) -> int:
        return len(next(iter((self.values or self.axes).values())))

    def grid(self, name: str) -> np.ndarray:
        """Values as an array with one dimension per axis; NaN where a coordinate has no row."""
        sides = [np.unique(a, return_inverse=True) for a in self.axes.values()]
        out = np.full([len(s[0]) for s in sides], np.nan)
        out[tuple(s[1] for s in sides)] = self.values[name]
        return out


def _array(column: pa.ChunkedArray) -> np.ndarray:
    if column.null_count and pa.types.is_integer(column.type):
        column = column.cast(pa.float64())
    return column.to_numpy()


def _slab(table: pa.Table, k: int, axes: tuple[str, ...], values: tuple[str, ...], cell: tuple) -> Slab:
    mine = table.filter(pc.equal(table["__cube"], k)).select([f"__{k}_{c}" for c in (*axes, *values)]).rename_columns([*axes, *values])
    if axes:
        mine = mine.sort_by([(a, "ascending") for a in axes])
    coords = {a: _array(mine[a]) for a in axes}
    if len(mine) > 1:
        twice = np.ones(len(mine) - 1, dtype=bool)
        for a in coords.values():
            twice &= a[1:] == a[:-1]
        if twice.any():
            raise ValueError(f"cube {k} has two rows for one place in cell {cell}")
    return Slab(coords, {v: _array(mine[v]) for v in values})


def _checked(result: dict, out: Output, fixed: dict[str, list], cell: tuple) -> dict[str, np.ndarray]:
    """The function's result as columns of equal length, without a place twice and along the declared coordinates."""
    names = {*out.axes, *out.values}
    if set(result) != names:
        raise ValueError(f"the function returned {sorted(result)}, not {sorted(names)}")
    columns = {c: np.atleast_1d(np.asarray(v)) for c, v in result.items()}
    if len({len(c) for c in columns.values()}) > 1 or (not out.axes and len(next(iter(columns.values()))) != 1):
        raise ValueError(f"results of cell {cell} do not fit their axes")
    if out.axes:
        places = list(zip(*(columns[a].tolist() for a in out.axes), strict=True))
        if len(set(places)) < len(places):
            raise ValueError(f"results of cell {cell} have two values for one place")
        for a, coords in fixed.items():
            if set(columns[a].tolist()) != set(coords):
                raise ValueError(f"axis {a} of cell {cell} is not as declared")
    return columns


def map_cubes(kernel: Callable[..., dict], inputs: list[Input], out: Output, loop: tuple[str, ...] = ("ilon", "ilat")) -> DataFrame:
    """(loop, output axes, output values): ``kernel(*slabs)`` for every cell of ``loop`` that the first cube has.

    A cell is one task's work at a time, so its slabs must fit there, as a series of days does.  A cube without rows in a
    cell gives an empty slab.  Null values come as NaN; null results are NaN or None.
    """
    parts = []
    for k, i in enumerate(inputs):
        parts.append(i.cube.select(*loop, F.lit(k).alias("__cube"), *(F.col(c).alias(f"__{k}_{c}") for c in (*i.axes, *i.values))))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    schema = inputs[0].cube.select(*loop).schema
    for name, kind in (out.axes | out.values).items():
        schema = schema.add(name, kind)
    declared, fixed = [(i.axes, i.values) for i in inputs], {a: list(c) for a, c in out.coords.items()}

    def run(table: pa.Table) -> pa.Table:
        cell = tuple(table[c][0].as_py() for c in loop)
        slabs = [_slab(table, k, axes, values, cell) for k, (axes, values) in enumerate(declared)]
        if not len(slabs[0]):
            return pa.Table.from_arrays([pa.array([], t) for t in arrow.types], schema=arrow)
        columns = _checked(kernel(*slabs), out_, fixed, cell)
        n = len(next(iter(columns.values())))
        held = [pa.array([v] * n, arrow.field(c).type) for c, v in zip(loop, cell, strict=True)]
        return pa.Table.from_arrays([*held, *(pa.array(columns[c], arrow.field(c).type, from_pandas=True) for c in names)], schema=arrow)

    arrow, names, out_ = to_arrow_schema(schema), [*out.axes, *out.values], Output(out.axes, out.values)
    return rows.groupBy(*loop).applyInArrow(run, schema)
