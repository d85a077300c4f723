"""Column helpers shared by the operators."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(x: Column) -> Column:
    """NaN counts as missing."""
    return F.nanvl(x, F.lit(None).cast("double"))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded to ``digits`` decimals by x * 10^d, rint, / 10^d.

    A shift far below the last digit decides exact ties, which sums in another order would let fall either way.
    """
    return F.rint(x * F.lit(10.0**digits) + F.lit(1e-4)) / F.lit(10.0**digits)


def area_weight(lat: Column) -> Column:
    """cos of the latitude, the relative area of a cell of a regular grid."""
    return F.cos(F.radians(lat))


def wmean(x: Column, w: Column) -> Column:
    """Weighted mean of what is known; null where nothing is."""
    x = known(x)
    return F.sum(x * w) / F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0))


def bit(code: Column, value: int) -> Column:
    return code.bitwiseAND(F.lit(value)) != 0


def all_of(flags: list[Column]) -> Column:
    return functools.reduce(operator.and_, flags)


def _erfc(x: Column) -> Column:
    series = F.lit(1.0)
    for k in range(59, 0, -1):
        series = 1.0 + x * x * (2.0 / (2 * k + 1)) * series
    tail = x
    for k in range(40, 0, -1):
        tail = x + F.lit(k / 2.0) / tail
    bell = F.exp(-x * x) / math.sqrt(math.pi)
    return F.when(x < 2.5, 1.0 - 2.0 * bell * x * series).otherwise(bell / tail)


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0, to about 1e-13 of its value however small it is.

    Below 2.5 one minus the series with positive terms, above it the continued fraction.  x is named once, as the
    variable of a lambda, so that the expression does not grow with what it is made of.
    """
    return F.transform(F.array(x), _erfc)[0]


def normal_tails(z: Column) -> Column:
    """Probability that a standard normal value is further from 0 than z."""
    return erfc(F.abs(z) / math.sqrt(2.0))
