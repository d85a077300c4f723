"""Trend tests and regressions on short series (years), many groups at a time.

Pairs are formed within a group only, by an equi-join on the group; a series has tens of years, so the pairs of a
group are bounded by the calendar, not by the data.  A series of more than ``LONGEST`` points fails the job.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratacube.functions.columns import normal_tails


#: Points of a series whose pairs are formed.
LONGEST = 2000


def _pairs(series: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    s = series.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    long = F.raise_error(F.lit(f"a series has more than {LONGEST} points")).cast("boolean")
    s = s.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.when(F.col("__n") > LONGEST, long).otherwise(F.lit(True)))
    a = s.select(*by, F.col(x).cast("double").alias("x1"), F.col(y).cast("double").alias("y1"))
    b = s.select(*by, F.col(x).cast("double").alias("x2"), F.col(y).cast("double").alias("y2"))
    return a.join(b, by)


def theil_sen(series: DataFrame, x: str, y: str, by: list[str], intercept: str = "established") -> DataFrame:
    """(by, slope, intercept): median of pairwise slopes, and of the residuals.

    'standard' takes the residuals' median; 'established' the published rule, which averages the sorted residuals
    at n/2 and n/2 + 2 for even n and takes the one at n div 2 for odd n (1-based).
    """
    slopes = _pairs(series, x, y, by).where("x1 <> x2").groupBy(*by).agg(F.percentile(F.expr("(y2 - y1) / (x2 - x1)"), 0.5).alias("slope"))
    rest = series.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(slopes, by).withColumn("rest", F.col(y) - F.col("slope") * F.col(x))
    if intercept == "standard":
        return rest.groupBy(*by).agg(F.first("slope").alias("slope"), F.percentile("rest", 0.5).alias("intercept"))
    w = Window.partitionBy(*by)
    placed = rest.withColumns({"n": F.count(F.lit(1)).over(w), "r": F.row_number().over(w.orderBy("rest", x))})
    half = F.floor(F.col("n") / 2)
    wanted = (F.col("r") == half) | ((F.col("n") % 2 == 0) & (F.col("r") == F.least(half + 2, F.col("n"))))
    return placed.where(wanted).groupBy(*by).agg(F.first("slope").alias("slope"), F.avg("rest").alias("intercept"))


def mann_kendall(series: DataFrame, x: str, y: str, by: list[str], alpha: float = 0.05) -> DataFrame:
    """(by, n, s, z, p_value, tau, reject, slope, intercept) without correction for ties.

    S = 0 gives z = -1 / sigma, as the established implementation does.  The slope is the median over ordered pairs
    of different times (pairs of one time have slopes of plus and of minus infinity in equal number, which leave the
    median where it is); the intercept the median residual.
    """
    p = _pairs(series, x, y, by)
    s = p.where("x1 < x2").groupBy(*by).agg(F.sum(F.signum(F.expr("y2 - y1"))).alias("s"))
    n = series.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"))
    sigma = F.sqrt(F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) / 18.0)
    z = F.when(F.col("s") >= 0, (F.col("s") - 1) / sigma).otherwise((F.col("s") + 1) / sigma)
    tested = s.join(n, by).withColumn("z", z).withColumn("p_value", normal_tails(F.col("z")))
    tested = tested.withColumns({"tau": F.col("s") / (F.lit(0.5) * F.col("n") * (F.col("n") - 1)), "reject": F.abs("z") > NormalDist().inv_cdf(1 - alpha / 2)})
    return tested.join(theil_sen(series, x, y, by, "standard"), by).select(*by, "n", "s", "z", "p_value", "tau", "reject", "slope", "intercept")


def ols_trend(series: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    return series.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def _best_through(xs: np.ndarray, ys: np.ndarray, ws: np.ndarray, q: float, i: int) -> tuple[float, int]:
    """Slope of least pinball loss among the lines through point i, and another point on that line.

    Along the slope the loss is a sum of hinges, one where the line meets each other point; the least is where the
    summed steepness turns from negative.
    """
    h, d = xs - xs[i], ys - ys[i]
    away = np.flatnonzero(h != 0)
    meets = d[away] / h[away]
    order = np.argsort(meets, kind="stable")
    steps = np.abs(h[away]) * ws[away]
    steep = np.cumsum(steps[order]) - np.where(h[away] > 0, q, 1 - q) @ steps
    k = min(int(np.searchsorted(steep, 0.0)), len(order) - 1)
    return float(meets[order[k]]), int(away[order[k]])


def _pinball(xs: np.ndarray, ys: np.ndarray, ws: np.ndarray, q: float, slope: float, i: int) -> float:
    rest = (ys - ys[i]) - slope * (xs - xs[i])
    return float((ws * np.where(rest >= 0, q * rest, (q - 1) * rest)).sum())


def quantile_line(xs: np.ndarray, ys: np.ndarray, q: float, ws: np.ndarray | None = None) -> tuple[float, float]:
    """(slope, intercept) of a line of least pinball loss over points of weight ``ws`` (1 by default); x must vary.

    Some best line goes through two points.  Starting from the point nearest to the least-squares line, the line is
    turned about one of its points to the best slope, then about the point it has met, until no point on it helps.
    """
    ws = np.ones(len(xs)) if ws is None else ws
    trend = np.polyfit(xs - xs.mean(), ys, 1)
    rest = ys - np.polyval(trend, xs - xs.mean())
    i = int(np.argmin(np.abs(rest - np.quantile(rest, q))))
    slope, j = _best_through(xs, ys, ws, q, i)
    loss = _pinball(xs, ys, ws, q, slope, i)
    while True:
        on = np.flatnonzero(np.abs((ys - ys[i]) - slope * (xs - xs[i])) <= 1e-9 * (1 + np.abs(ys - ys[i])))
        for k in (j, *on.tolist()):
            turned, met = _best_through(xs, ys, ws, q, k)
            less = _pinball(xs, ys, ws, q, turned, k)
            if less < loss * (1 - 1e-12) - 1e-300:
                i, slope, j, loss = k, turned, met, less
                break
        else:
            return slope, float(ys[i] - slope * xs[i])


def quantile_regression(points: DataFrame, x: str, y: str, by: list[str], probs: list[float]) -> DataFrame:
    """(by, quantile, slope, intercept) of a line that minimises the pinball loss, exactly; null where x takes one value only.

    A group goes to one task as two columns of doubles, some hundred MB for ten million points; groups that may be
    larger go to ``regression.large_quantile_regression``.
    """
    schema = points.select(*by).schema.add("quantile", "double").add("slope", "double").add("intercept", "double")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        good = pdf[[x, y]].dropna().sort_values([x, y])
        xs, ys = good[x].to_numpy(float), good[y].to_numpy(float)
        rows = [(q, *(quantile_line(xs, ys, q) if good[x].nunique() > 1 else (None, None))) for q in probs]
        out = pd.DataFrame(rows, columns=["quantile", "slope", "intercept"])
        for i, c in enumerate(by):
            out.insert(i, c, pdf[c].iloc[0])
        return out

    return points.select(*by, x, y).groupBy(*by).applyInPandas(fit, schema)


def pinball_loss(points: DataFrame, lines: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, quantile, loss) of lines (by, quantile, slope, intercept) over the points of their group."""
    rest = F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")
    q = F.col("quantile")
    return points.join(lines, by).groupBy(*by, "quantile").agg(F.sum(F.when(rest >= 0, q * rest).otherwise((q - 1) * rest)).alias("loss"))
