"""Bit-coded threshold events."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacube.functions.columns import all_of, bit

LAYERS = ("HW", "D30", "D90", "D180")


def event_code(layers: list[Column], thresholds: float | list[float], non_extreme: float | None = None, compare: list | None = None) -> Column:
    """Bit i set where layer i passes its threshold (strictly below, unless ``compare`` gives the tests).

    With ``non_extreme`` the next bit is set where all layers lie strictly inside (non_extreme, 1 - non_extreme).
    At most seven layers; a missing value sets no bit.
    """
    if not 0 < len(layers) <= 7:
        raise ValueError("one to seven layers")
    limits = thresholds if isinstance(thresholds, list) else [thresholds] * len(layers)
    tests = compare or [operator.lt] * len(layers)
    bits = [F.when(test(x, F.lit(t)), 1 << i).otherwise(0) for i, (x, t, test) in enumerate(zip(layers, limits, tests, strict=True))]
    if non_extreme is not None:
        inside = all_of([(x > non_extreme) & (x < 1 - non_extreme) for x in layers])
        bits.append(F.when(inside, 1 << len(layers)).otherwise(0))
    return functools.reduce(lambda a, b: a.bitwiseOR(b), bits).cast("int")


def is_compound(code: Column, hot: int = 1, dry: int = 14) -> Column:
    return bit(code, hot) & bit(code, dry)


def is_extreme(code: Column, non_extreme_bit: int = 16) -> Column:
    return (code > 0) & (code < non_extreme_bit)


def macro_type(code: Column) -> Column:
    """hot, dry or hot+dry of an extreme code."""
    return F.when(code == 1, "hot").when(code % 2 == 0, "dry").otherwise("hot+dry")


def code_label(code: Column, names=LAYERS) -> Column:
    return F.concat_ws("_", *(F.when(bit(code, 1 << i), n) for i, n in enumerate(names)))


def code_flags(cube: DataFrame, code: str = "event") -> DataFrame:
    return cube.withColumns({n: bit(F.col(code), 1 << i) for i, n in enumerate(("heat", "d30", "d90", "d180"))})
