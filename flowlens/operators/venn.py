"""Venn-Abers intervals, exactly, for any number of scores: two isotonic fits a score without fitting any of them.

The isotonic fit at a score is the slope of the lower hull of the sums (rows, positives) there. With a row added at the
score, the sums before it stay and those from it on move by that row, so the fit is the slope of the line that touches
both hulls from below. Scores are laid out in ranges; a range's task has its own sums and the hulls of the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.operators.metrics import adjust_to_prior, wilson
from flowlens.session import written

#: Bisections of a slope between 0 and 1: what is left is below the spacing of floats at one half.
HALVINGS = 54


def chain_down(n: list[int], y: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(below, slope) of each point, n not falling and y the same where n is: the point before it on the lower hull of
    all points so far (-1: none), and the slope from there (minus infinity: none)."""
    below, slope, stack = np.full(len(n), -1), np.full(len(n), -np.inf), []
    for i in range(len(n)):
        while stack:
            top = stack[-1]
            under, run, rise = int(below[top]), n[i] - n[top], y[i] - y[top]
            if run and (under < 0 or (y[top] - y[under]) * run < rise * (n[top] - n[under])):
                below[i], slope[i] = top, rise / run
                break
            stack.pop()
        stack.append(i)
    return below, slope


def hull(n: list[int], y: list[int]) -> list[int]:
    """Positions of the vertices of the lower hull."""
    below, _ = chain_down(n, y)
    at, found = len(n) - 1, []
    while at >= 0:
        found.append(at)
        at = below[at]
    return found[::-1]


class Tangents:
    """Where lines of given slopes touch the hull of a sequence's first points, for many ends at once."""

    def __init__(self, n: np.ndarray, y: np.ndarray, turn: int = 1) -> None:
        """turn -1: points in falling order of n, for hulls of what comes after."""
        self.n, self.y, self.turn = n, y, turn
        # turned about the vertical axis, falling points rise and slopes change their sign
        below, slope = chain_down((turn * n).tolist(), y.tolist())
        self.slope, self.below = slope, np.where(below < 0, np.arange(len(n)), below)
        self.jumps = [self.below]
        while (self.jumps[-1] != self.jumps[-1][self.jumps[-1]]).any():
            self.jumps.append(self.jumps[-1][self.jumps[-1]])

    def touch(self, ends: np.ndarray, slopes: np.ndarray) -> np.ndarray:
        """The lowest point, along the slope, among the points up to each end."""
        at, slopes = ends, self.turn * slopes
        for jump in self.jumps[::-1]:
            far = jump[at]
            at = np.where(self.slope[far] > slopes, far, at)
        return np.where(self.slope[at] > slopes, self.below[at], at)


def bridge(left: Tangents, right: Tangents, i: np.ndarray, j: np.ndarray, y: int) -> np.ndarray:
    """Slopes of the lines below the left points up to i and the right ones up to j, which a row of label y moved."""
    low, high = np.zeros(len(i)), np.ones(len(i))
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        a, b = left.touch(i, middle), right.touch(j, middle)
        above = (right.y[b] - left.y[a] + y) > middle * (right.n[b] - left.n[a] + 1)
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    a, b = left.touch(i, (low + high) / 2), right.touch(j, (low + high) / 2)
    return (right.y[b] - left.y[a] + y) / (right.n[b] - left.n[a] + 1)


def _real(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))


def venn_abers(calibration: DataFrame, queries: DataFrame, per_range: int = 200_000) -> DataFrame:
    """(score, p0, p1, p) of each distinct score of queries: the isotonic fit of the calibration rows (score, y) and one
    row at the score, if it were negative and if it were positive, and both in one number.

    Calibration rows without a score or label (null, NaN) don't count, and such queries have no row. Without
    calibration p0 is 0, p1 is 1. Rows of a score are summed before they meet, so one that a third of all rows share is
    one row. Ranges hold about per_range distinct scores. What tasks share is the ranges' hulls: of n rows a hull has
    less than n ** (2 / 3) points, as its slopes are different fractions; over smooth scores, about n ** (1 / 3).
    """
    known = calibration.where(_real("score") & F.col("y").isNotNull())
    sums = known.groupBy(F.col("score").cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos"))
    asked = queries.where(_real("score")).select(F.col("score").cast("double").alias("score")).distinct()
    both = sums.withColumn("asked", F.lit(0)).unionByName(asked.select("score", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"), F.lit(1).alias("asked")))
    both = written(both.groupBy("score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.max("asked").alias("asked")), "scores")
    ranges = max(1, -(-both.count() // per_range))
    placed = written(both.repartitionByRange(ranges, "score").withColumn("range", F.spark_partition_id()), "score-ranges")

    def own_hull(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("score")
        n, y = rows["n"].cumsum().tolist(), rows["pos"].cumsum().tolist()
        at = hull(n, y)
        return pd.DataFrame({"range": [int(rows["range"].iloc[0])], "n": [n[-1]], "pos": [y[-1]], "hn": [[n[k] for k in at]], "hy": [[y[k] for k in at]]})

    found = placed.groupBy("range").applyInPandas(own_hull, "range int, n long, pos long, hn array<long>, hy array<long>")
    hulls = {r["range"]: (r["n"], r["pos"], np.array(r["hn"]), np.array(r["hy"])) for r in found.collect()}

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("score")
        own = int(rows["range"].iloc[0])
        sides, start, total = {False: [], True: []}, (0, 0), (0, 0)
        for number in sorted(hulls):
            n, pos, hn, hy = hulls[number]
            if number == own:
                start = total
            else:
                sides[number > own].append((total[0] + hn, total[1] + hy))
            total = (total[0] + n, total[1] + pos)
        before = [np.concatenate([np.array([0]), *[s[k] for s in sides[False]]]) for k in (0, 1)]
        after = [np.concatenate([np.array([], dtype="int64"), *[s[k] for s in sides[True]]])[::-1] for k in (0, 1)]
        here = [start[k] + rows[c].cumsum().to_numpy() for k, c in enumerate(("n", "pos"))]
        left = Tangents(*[np.concatenate([before[k], here[k]]).astype("int64") for k in (0, 1)])
        right = Tangents(*[np.concatenate([after[k], here[k][::-1]]).astype("int64") for k in (0, 1)], turn=-1)
        at = np.flatnonzero(rows["asked"].to_numpy())
        i, j = len(before[0]) + at - 1, len(after[0]) + len(rows) - 1 - at
        p0, p1 = (bridge(left, right, i, j, y) for y in (0, 1))
        return pd.DataFrame({"score": rows["score"].to_numpy()[at], "p0": p0, "p1": p1, "p": p1 / (1 - p0 + p1)})

    return placed.groupBy("range").applyInPandas(fit, "score double, p0 double, p1 double, p double")


def intervals(calibration: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (score, ...) with p0, p1 and p; null where a score is null or NaN."""
    found = venn_abers(calibration, rows).withColumnRenamed("score", "__score")
    return rows.join(found, F.col("score").cast("double") == F.col("__score"), "left").drop("__score")


def moved(found: DataFrame, old: float, new: float) -> DataFrame:
    """Intervals under another share of positives; p is merged again from the ends."""
    ends = found.withColumns({c: adjust_to_prior(F.col(c), old, new) for c in ("p0", "p1")})
    return ends.withColumn("p", F.col("p1") / (1 - F.col("p0") + F.col("p1")))


def report(found: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, low, high, observed, ci_low, ci_high, inside) over rows (idx, y, p0, p1, p): rows in order of p (then idx)
    in bins of equal size, the first ones a row longer; inside: the interval meets that of the observed share.

    Rows meet in a thousand ranges of p, so that places are sums of ranges and a place within one.
    """
    ranged = found.where("p is not null").withColumn("range", F.floor(F.col("p") * 1000))
    totals = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    totals = totals.select("range", F.coalesce(F.sum("size").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("size").over(W.partitionBy(F.lit(1))).alias("all"))
    placed = ranged.join(totals, "range").withColumn("place", F.col("start") + F.row_number().over(W.partitionBy("range").orderBy("p", "idx")) - 1)
    size, longer = F.expr(f"all div {bins}"), F.expr(f"all % {bins}")
    number = F.when(F.col("place") < longer * (size + 1), F.expr(f"place div (all div {bins} + 1)")).otherwise(longer + F.floor((F.col("place") - longer * (size + 1)) / F.greatest(size, F.lit(1))))
    per = placed.groupBy(number.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p0").alias("low"), F.avg("p1").alias("high"), F.sum(F.col("y").cast("long")).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"), 1.96)
    inside = (F.col("high") >= low - 1e-9) & (F.col("low") <= high + 1e-9)
    four = lambda c: F.round(c, 4)
    return per.select("bin", "n", four(F.col("low")).alias("low"), four(F.col("high")).alias("high"), four(F.col("hits") / F.col("n")).alias("observed"), four(low).alias("ci_low"), four(high).alias("ci_high"), inside.alias("inside"))
