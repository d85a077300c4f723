"""Quantile regression over groups of any size: cutting planes from sums over all points, then an exact end on the few points left.

The loss of a line is convex in slope and intercept.  For a handful of trial lines at a time every task adds up their
losses and subgradients over its points; each trial cuts off the half of a polygon in which no best line can lie.  A point
that is above, or below, all lines of the polygon counts there as its weight at the mean of all such points.  Once few
points are left between the polygon's lines the problem of these points and the two means has the same best line, which
is found exactly and then held against the loss over all points.  Where more points than that lie on the best line itself the polygon
shrinks to nothing, and the best of the lines tried is the answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacube.functions.columns import known
from stratacube.operators.trends import quantile_line
from stratacube.sources.workspace import Workspace

#: Points of one group and quantile that the exact end takes; trial lines of a round; rounds.
POINTS, TRIALS, ROUNDS = 1 << 18, 8, 80
#: Width of a polygon, in units of the data's own spread, whose lines are one; one that no trial cuts has that of rounding.
NOTHING = 1e-10
#: Groups whose polygons the driver holds; a group among them has more than ``POINTS`` points.
MOST_GROUPS = 1 << 16
_SUMS = "g int, q int, t int, loss double, above double, above_x double, left long"


class _Fit:
    """Polygon of (intercept, slope) of one group and quantile, in scaled coordinates."""

    def __init__(self, q: float, n: float, sum_x2: float, sum_y: float):
        self.q, self.n, self.best, self.line, self.done = q, n, np.inf, None, False
        worst, least = max(q, 1 - q) * sum_y, min(q, 1 - q)
        a, b = (worst / least + sum_y) / n + 1e-9, (worst / least + sum_y) / sum_x2 + 1e-9
        self.polygon = np.array([(-a, -b), (a, -b), (a, b), (-a, b)])

    def trials(self) -> np.ndarray:
        p = self.polygon
        nxt = np.roll(p, -1, axis=0)
        cross = p[:, 0] * nxt[:, 1] - nxt[:, 0] * p[:, 1]
        area = cross.sum()
        middle = ((p + nxt) * cross[:, None]).sum(axis=0) / (3 * area) if abs(area) > 1e-300 else p.mean(axis=0)
        if not np.isfinite(middle).all() or (np.abs(middle) > np.abs(p).max(axis=0) * (1 + 1e-9)).any():
            middle = p.mean(axis=0)
        some = p[np.linspace(0, len(p) - 1, min(len(p), TRIALS - 1)).round().astype(int)]
        return np.vstack([middle, (some + middle) / 2])

    def cut(self, trials: np.ndarray, sums: np.ndarray, total_x: float) -> None:
        """``sums``: loss, weight above and its x, for each trial."""
        for t, (loss, above, above_x) in zip(trials, sums, strict=True):
            g = np.array([(1 - self.q) * self.n - above, (1 - self.q) * total_x - above_x])
            slack = 1e-11 * (loss + np.abs(g) @ (np.abs(t) + np.abs(self.polygon).max(axis=0))) + 1e-300
            side = (self.polygon - t) @ g - (self.best - loss) - slack  # positive: no best line there
            if (side <= 0).all():
                continue
            if (side > 0).all():
                break
            kept = []
            for k in range(len(side)):
                j = (k + 1) % len(side)
                if side[k] <= 0:
                    kept.append(self.polygon[k])
                if (side[k] <= 0) != (side[j] <= 0):
                    kept.append(self.polygon[k] + (self.polygon[j] - self.polygon[k]) * (side[k] / (side[k] - side[j])))
            self.polygon = np.array(kept)


def _between(polygon: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a point is above, and below, every line of the polygon."""
    lines = polygon[:, :1] + polygon[:, 1:] * x
    return y > lines.max(axis=0), y < lines.min(axis=0)


def _by_group(batch: pa.RecordBatch, scale: dict):
    g, x, y, w = (batch.column(k).to_numpy() for k in range(4))
    for k in np.unique(g).tolist():
        mine = g == k
        mx, sx, my, sy = scale[k]
        yield k, (x[mine] - mx) / sx, (y[mine] - my) / sy, w[mine].astype(float)


def _round_sums(fits: dict, trials: dict, scale: dict):
    def run(batches):
        total: dict = {}
        for batch in batches:
            for k, x, y, w in _by_group(batch, scale):
                for q, fit in fits[k].items():
                    lines = trials[k, q]
                    rest = y - lines[:, :1] - lines[:, 1:] * x
                    up = rest >= 0
                    loss = (np.where(up, fit.q, fit.q - 1) * rest * w).sum(axis=1)
                    above, below = _between(fit.polygon, x, y)
                    sums = np.stack([loss, (up * w).sum(axis=1), (up * (w * x)).sum(axis=1)], axis=1)
                    held = total.setdefault((k, q), [np.zeros_like(sums), 0])
                    held[0] += sums
                    held[1] += int((~above & ~below).sum())
        rows = [(k, q, t, *s, left if t == 0 else 0) for (k, q), (sums, left) in total.items() for t, s in enumerate(sums.tolist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) if i > 2 else pa.array(c, pa.int32()) for i, c in enumerate(zip(*rows, strict=True))], _SUMS.replace(",", "").split()[::2])

    return run


def _rest(fits: dict, scale: dict):
    """(g, q, x, y, w, side): points between the lines of a polygon as they are, the others as sums of w, w x and w y by side."""

    def run(batches):
        glob: dict = {}
        for batch in batches:
            for k, x, y, w in _by_group(batch, scale):
                for q, fit in fits[k].items():
                    above, below = _between(fit.polygon, x, y)
                    left = ~above & ~below
                    n = int(left.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, q, np.int32)), pa.array(x[left]), pa.array(y[left]), pa.array(w[left]), pa.array(np.zeros(n, np.int32))], ["g", "q", "x", "y", "w", "side"])
                    for side, some in ((1, above), (-1, below)):
                        held = glob.setdefault((k, q, side), np.zeros(3))
                        held += (w[some] @ np.stack([x[some], y[some], np.ones(int(some.sum()))], axis=1)) if some.any() else 0
        rows = [(k, q, *s.tolist(), side) for (k, q, side), s in glob.items() if s[2] > 0]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["g", "q", "x", "y", "w", "side"])

    return run


def large_quantile_regression(points: DataFrame, x: str, y: str, by: list[str], probs: list[float], most_points: int = POINTS) -> DataFrame:
    """(by, quantile, slope, intercept) of a line that minimises the pinball loss in each group; ``by`` may be empty.

    Points with an unknown coordinate are left out; a group whose x takes one value has null lines; a null key is a group
    of its own.  Groups of at most ``most_points`` distinct points go to one task each, as they are; larger ones are cut
    down to that first.
    """
    spark = points.sparkSession
    ws = Workspace(spark, "regression")
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("one"))
    read = points.select(key.alias("k"), known(F.col(x).cast("double")).alias("x"), known(F.col(y).cast("double")).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    base = ws.save(read.groupBy("k", "x", "y").agg(F.count("*").alias("w")), "points")
    sizes = ws.save(base.groupBy("k").agg(F.count("*").alias("points"), F.sum("w").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.min("y").alias("y0"), F.max("y").alias("y1")), "sizes")
    names = sizes.select("k").schema.add("q", "integer").add("slope", "double").add("intercept", "double")

    def exact(pdf):
        rows = []
        one = pdf["x"].nunique() < 2
        for q, p in enumerate(probs):
            slope, intercept = (None, None) if one else quantile_line(pdf["x"].to_numpy(), pdf["y"].to_numpy(), p, pdf["w"].to_numpy(dtype=float))
            rows.append((pdf["k"].iloc[0], q, slope, intercept))
        import pandas as pd

        return pd.DataFrame(rows, columns=["k", "q", "slope", "intercept"])

    big = (F.col("points") > most_points) & (F.col("x0") < F.col("x1"))
    small = base.join(sizes.where(~big).select(F.col("k").alias("of")), F.col("k") == F.col("of"), "left_semi").groupBy("k").applyInPandas(exact, names)
    count = sizes.where(big).count()
    if count > MOST_GROUPS:
        raise ValueError(f"{count} groups of more than {most_points} points; raise most_points")
    if count:
        small = small.unionByName(_large(base, ws, sizes.where(big), probs, most_points))
    of_q = F.element_at(F.array(*(F.lit(float(p)) for p in probs)), F.col("q") + 1)
    return small.select(*(F.col(f"k.{c}").alias(c) for c in by), of_q.alias("quantile"), "slope", "intercept")


def _large(base: DataFrame, ws: Workspace, sizes: DataFrame, probs: list[float], most_points: int) -> DataFrame:
    spark = base.sparkSession
    info = sizes.collect()  # at most MOST_GROUPS
    groups = spark.createDataFrame([(r["k"], g) for g, r in enumerate(info)], sizes.select("k").schema.add("g", "integer"))
    numbered = ws.save(base.join(F.broadcast(groups.withColumnRenamed("k", "of")), F.col("k") == F.col("of")).select("g", "x", "y", "w"), "large")
    scale = {g: (r["mx"], max(r["x1"] - r["mx"], r["mx"] - r["x0"]), r["my"], max(r["y1"] - r["my"], r["my"] - r["y0"], 1e-300)) for g, r in enumerate(info)}
    centre = F.create_map(*(c for g, s in scale.items() for c in (F.lit(g), F.array(*(F.lit(float(v)) for v in s)))))[F.col("g")]
    sx, sy = (F.col("x") - centre[0]) / centre[1], (F.col("y") - centre[2]) / centre[3]
    totals = {r["g"]: r for r in numbered.groupBy("g").agg(F.sum(F.col("w") * sx * sx).alias("xx"), F.sum(F.col("w") * sx).alias("x"), F.sum(F.col("w") * F.abs(sy)).alias("y")).collect()}
    fits = {g: {q: _Fit(p, float(info[g]["n"]), totals[g]["xx"], totals[g]["y"]) for q, p in enumerate(probs)} for g in scale}
    for _ in range(ROUNDS):
        open_ = {g: {q: f for q, f in of.items() if not f.done} for g, of in fits.items()}
        open_ = {g: of for g, of in open_.items() if of}
        if not open_:
            break
        trials = {(g, q): f.trials() for g, of in open_.items() for q, f in of.items()}
        sums = numbered.where(F.col("g").isin(list(open_))).mapInArrow(_round_sums(open_, trials, scale), _SUMS)
        sums = sums.groupBy("g", "q", "t").agg(*(F.sum(c).alias(c) for c in ("loss", "above", "above_x", "left"))).orderBy("g", "q", "t").collect()
        for g, q in trials:
            mine = [r for r in sums if (r["g"], r["q"]) == (g, q)]
            fit = open_[g][q]
            least = min(mine, key=lambda r: r["loss"])
            if least["loss"] < fit.best:
                fit.best, fit.line = least["loss"], trials[g, q][least["t"]].tolist()
            if mine[0]["left"] <= most_points:
                fit.done, fit.line = True, None
            else:
                before = fit.polygon
                fit.cut(trials[g, q], np.array([(r["loss"], r["above"], r["above_x"]) for r in mine]), totals[g]["x"])
                fit.done = np.array_equal(before, fit.polygon) or bool((np.ptp(fit.polygon, axis=0) <= NOTHING * (1 + np.abs(fit.polygon).max(axis=0))).all())
    else:
        raise RuntimeError("the lines did not settle")

    found = [(g, q, f.line[1], f.line[0]) for g, of in fits.items() for q, f in of.items() if f.line]
    fits_open = {g: {q: f for q, f in of.items() if not f.line} for g, of in fits.items()}

    def solve(pdf):
        import pandas as pd

        left = pdf[pdf["side"] == 0]
        xs, ys, ws = ([*left[c]] for c in ("x", "y", "w"))
        for side in (1, -1):
            some = pdf[pdf["side"] == side]
            n = some["w"].sum()
            if n > 0:
                xs.append(some["x"].sum() / n)
                ys.append(some["y"].sum() / n)
                ws.append(n)
        slope, intercept = quantile_line(np.array(xs), np.array(ys), probs[int(pdf["q"].iloc[0])], np.array(ws))
        return pd.DataFrame([(pdf["g"].iloc[0], pdf["q"].iloc[0], slope, intercept)], columns=["g", "q", "slope", "intercept"])

    kind = "g int, q int, slope double, intercept double"
    solved = numbered.mapInArrow(_rest(fits_open, scale), "g int, q int, x double, y double, w double, side int").groupBy("g", "q").applyInPandas(solve, kind)
    lines = ws.save(solved.unionByName(spark.createDataFrame(found, kind)), "lines")
    # the exact check: no trial line, and so no line outside the polygon, has less loss over all points
    p = F.element_at(F.array(*(F.lit(float(v)) for v in probs)), F.col("q") + 1)
    rest = sy - F.col("intercept") - F.col("slope") * sx
    loss = numbered.join(F.broadcast(lines), "g").groupBy("g", "q").agg(F.sum(F.col("w") * F.when(rest >= 0, p * rest).otherwise((p - 1) * rest)).alias("loss"))
    for r in loss.collect():
        if r["loss"] > fits[r["g"]][r["q"]].best * (1 + 1e-9) + 1e-9:
            raise RuntimeError(f"the line of group {r['g']}, quantile {probs[r['q']]}, is not the best one")
    slope = F.col("slope") * centre[3] / centre[1]
    intercept = centre[2] + F.col("intercept") * centre[3] - slope * centre[0]
    return lines.join(F.broadcast(groups), "g").select("k", "q", slope.alias("slope"), intercept.alias("intercept"))
