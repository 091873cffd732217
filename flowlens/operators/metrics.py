"""How good scores are: ranking, calibration, selective prediction, splits. Scored rows are (idx, y, score, ...).

Rows meet by score first, so that ties are one step and a window runs over distinct scores; where a global order is
needed, scores fall into ranges whose totals are summed before, so that no task sorts all rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions import stats

#: Ranges of scores over which global prefix sums run.
RANGES = 1000


def steps(scored: DataFrame, descending: bool = True) -> DataFrame:
    """score, pos, n, tp, seen: per distinct score, its rows and the sums up to it.

    Windows run over the distinct scores of one range each, and over the ranges' totals.
    """
    per = scored.groupBy("score").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("range", F.floor(F.col("score") * RANGES))
    way = (lambda c: F.col(c).desc()) if descending else F.col
    totals = per.groupBy("range").agg(F.sum("pos").alias("rp"), F.sum("n").alias("rn"))
    before = W.orderBy(way("range")).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("range", F.coalesce(F.sum("rp").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("rn").over(before), F.lit(0)).alias("n0"))
    within = W.partitionBy("range").orderBy(way("score")).rowsBetween(W.unboundedPreceding, 0)
    joined = per.join(totals, "range")
    return joined.select("score", "pos", "n", (F.col("p0") + F.sum("pos").over(within)).alias("tp"), (F.col("n0") + F.sum("n").over(within)).alias("seen"))


def pr_auc(scored: DataFrame) -> DataFrame:
    """Average precision: the gain in recall at each distinct score times the precision there."""
    return steps(scored).agg(F.round(F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.sum("pos"), 8).alias("pr_auc"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """The chance that a positive scores above a negative, ties half."""
    up = steps(scored, descending=False)
    below = (F.col("seen") - F.col("tp")) - (F.col("n") - F.col("pos"))
    wins = F.sum(F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2))
    return up.agg(F.round(wins / (F.sum("pos") * (F.sum("n") - F.sum("pos"))), 8).alias("roc_auc"))


def precision_at(scored: DataFrame, ks: list[int]) -> DataFrame:
    """k, precision, mean_score over the k best; each is a top-k, never a whole sort."""
    out = None
    for k in ks:
        top = scored.orderBy(F.col("score").desc(), "idx").limit(k).agg(F.lit(k).cast("long").alias("k"), F.round(F.avg("y"), 6).alias("precision"), F.round(F.avg("score"), 6).alias("mean_score"))
        out = top if out is None else out.unionByName(top)
    return out


def recall_at_precision(scored: DataFrame, least: float) -> DataFrame:
    """The most positives that a threshold finds at such precision, as a share of all."""
    hit = F.max(F.when(F.col("tp") >= least * F.col("seen"), F.col("tp")))
    return steps(scored).agg(F.round(F.coalesce(hit, F.lit(0)) / F.sum("pos"), 8).alias("recall"))


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_score, mean_y over bins of equal width."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("long")
    return scored.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 8).alias("mean_score"), F.round(F.avg("y"), 8).alias("mean_y"))


def expected_calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    per = reliability(scored, bins)
    return per.agg(F.round(F.sum(F.abs(F.col("mean_score") - F.col("mean_y")) * F.col("n")) / F.sum("n"), 6).alias("ece"))


def adaptive_bins(scored: DataFrame, bins: int) -> DataFrame:
    """bin, n, mean_score, mean_y over bins of equal size; the first ones have one row more where it doesn't divide.

    A row's place is the count of ranges before its own plus its rank inside.
    """
    rows = scored.withColumn("range", F.floor(F.col("score") * RANGES))
    totals = rows.groupBy("range").agg(F.count(F.lit(1)).alias("rn"))
    total = F.broadcast(totals.agg(F.sum("rn").alias("all")))
    sums = totals.withColumn("n0", F.coalesce(F.sum("rn").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).join(total)
    place = F.col("n0") + F.row_number().over(W.partitionBy("range").orderBy("score", "idx")) - 1
    size, more = F.expr(f"all div {bins}"), F.expr(f"all % {bins}")
    wide = more * (size + 1)
    at = F.when(F.col("place") < wide, F.expr(f"place div ((all div {bins}) + 1)")).otherwise(more + F.expr(f"(place - (all % {bins}) * ((all div {bins}) + 1)) div greatest(all div {bins}, 1)"))
    placed = rows.join(sums, "range").withColumn("place", place).withColumn("bin", at)
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 8).alias("mean_score"), F.round(F.avg("y"), 8).alias("mean_y"))


def threshold_sweep(scored: DataFrame, thresholds: int = 99) -> DataFrame:
    """threshold, tp, fp, tn, fn, precision, recall, f1, mcc, balanced_accuracy at t / (thresholds + 1).

    Rows fall between thresholds once; sums over those few cells give every threshold, without a product of rows.
    """
    cells = scored.groupBy(F.floor(F.col("score") * (thresholds + 1) + 1e-9).cast("long").alias("cell")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    grid = scored.sparkSession.range(1, thresholds + 1).withColumnRenamed("id", "t")
    all_ = F.broadcast(cells.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q")))
    met = grid.join(F.broadcast(cells), F.col("cell") >= F.col("t"), "left").groupBy("t").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    rows = met.join(all_).select("t", "tp", "fp", (F.col("q") - F.col("fp")).alias("tn"), (F.col("p") - F.col("tp")).alias("fn"))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    safe = lambda a, d: F.when(d > 0, F.round(a / d, 6)).otherwise(F.lit(0.0))
    return rows.select(
        F.round(F.col("t") / (thresholds + 1), 4).alias("threshold"), "tp", "fp", "tn", "fn", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"),
        safe(2 * tp, 2 * tp + fp + fn).alias("f1"), safe(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
        safe(tp * (tn + fp) + tn * (tp + fn), 2 * (tp + fn) * (tn + fp)).alias("balanced_accuracy"),
    )


def risk_coverage(scored: DataFrame, wrong: Column) -> DataFrame:
    """n, errors, aurc, oracle, excess: mean error of the most confident k, over all k; and with perfect order.

    The sum over k of errors(k) / k is taken range by range, with the errors and rows before a range as offsets.
    """
    rows = scored.select("idx", "score", wrong.cast("long").alias("wrong")).withColumn("range", F.floor(F.col("score") * RANGES))
    totals = rows.groupBy("range").agg(F.sum("wrong").alias("rw"), F.count(F.lit(1)).alias("rn"))
    before = W.orderBy(F.col("range").desc()).rowsBetween(W.unboundedPreceding, -1)
    sums = totals.select("range", F.coalesce(F.sum("rw").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("rn").over(before), F.lit(0)).alias("n0"))
    within = W.partitionBy("range").orderBy(F.col("score").desc(), "idx")
    placed = rows.join(sums, "range").select("wrong", (F.col("w0") + F.sum("wrong").over(within.rowsBetween(W.unboundedPreceding, 0))).alias("e"), (F.col("n0") + F.row_number().over(within)).alias("k"))
    all_ = F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"), F.sum("wrong").alias("errors")))
    best = F.greatest(F.col("k") - (F.col("n") - F.col("errors")), F.lit(0)) / F.col("k")
    per = placed.join(all_).groupBy("n", "errors").agg(F.avg(F.col("e") / F.col("k")).alias("aurc"), F.avg(best).alias("oracle"))
    return per.select("n", "errors", F.round("aurc", 6).alias("aurc"), F.round("oracle", 6).alias("oracle"), F.round(F.col("aurc") - F.col("oracle"), 6).alias("excess"))


def queue_order(scored: DataFrame, limit: int) -> DataFrame:
    """The first rows of the working queue: by score to two digits, then amount, then score."""
    return scored.orderBy(F.round("score", 2).desc(), F.col("amount").desc(), F.col("score").desc(), "idx").limit(limit).select("idx", "score", "amount")


def brier_bins(scored: DataFrame, edges: list[float]) -> DataFrame:
    """bin, n, mean_score, mean_y, brier, constant over fixed bins; constant is the score of always saying mean_y."""
    at = F.lit(0)
    for k, e in enumerate(edges, 1):
        at = F.when(F.col("score") >= e, k).otherwise(at)
    return scored.groupBy(at.cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 8).alias("mean_score"), F.round(F.avg("y"), 8).alias("mean_y"),
        F.round(F.avg((F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))), 6).alias("brier"), F.round(F.avg("y") * (1 - F.avg("y")), 6).alias("constant"),
    )


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a share."""
    p = hits / n
    middle, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.round(F.greatest(middle - spread, F.lit(0.0)), 6), F.round(F.least(middle + spread, F.lit(1.0)), 6)


def adjust_to_prior(score: Column, old: Column | float, new: Column | float) -> Column:
    """A score under another share of positives, by the change of the odds."""
    p = F.least(F.greatest(score, F.lit(1e-6)), F.lit(1 - 1e-6))
    old, new = (F.lit(x) if isinstance(x, float) else x for x in (old, new))
    up, down = p * new / old, (1 - p) * (1 - new) / (1 - old)
    return up / (up + down)


def em_prior(scored: DataFrame, start: float, tolerance: float = 1e-7, rounds: int = 200) -> float:
    """The share of positives at which the adjusted scores average to it; each round is one pass that returns one number."""
    share = start
    for _ in range(rounds):
        new = float(scored.agg(F.avg(adjust_to_prior(F.col("score"), start, share))).first()[0])
        if abs(new - share) < tolerance:
            return new
        share = min(max(new, 1e-6), 1 - 1e-6)
    return share


def clopper_pearson(hits: Column, n: Column) -> Column:
    """struct(low, high)."""

    def interval(h: pd.Series, k: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([stats.clopper_pearson(int(a), int(b)) for a, b in zip(h, k)], columns=["low", "high"])

    return F.pandas_udf(interval, T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))(hits, n)


def upper_bound(hits: Column, n: Column, level: float = 0.95) -> Column:
    """The exact one-sided upper bound of a share."""

    def bound(h: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([stats.upper_bound(int(a), int(b), level) for a, b in zip(h, k)], dtype="float64")

    return F.pandas_udf(bound, T.DoubleType())(hits, n)


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([stats.fisher_exact(*map(int, x)) for x in zip(a, b, c, d)], dtype="float64")

    return F.pandas_udf(p, T.DoubleType())(a, b, c, d)


def time_split(rows: DataFrame, order: list[str], shares: tuple[float, float] = (0.6, 0.2), ranges: str = "day") -> DataFrame:
    """rows with split (train, validation, test) forward in time; ranges names the column of coarse time."""
    totals = rows.groupBy(ranges).agg(F.count(F.lit(1)).alias("rn"))
    n = F.broadcast(rows.agg(F.count(F.lit(1)).alias("all")))
    sums = totals.select(ranges, F.coalesce(F.sum("rn").over(W.orderBy(ranges).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("n0")).join(n)
    place = F.col("n0") + F.row_number().over(W.partitionBy(ranges).orderBy(*order))
    first, second = F.floor(F.col("all") * shares[0]), F.floor(F.col("all") * (shares[0] + shares[1]))
    return rows.join(sums, ranges).withColumn("i", place).withColumn("split", F.when(F.col("i") <= first, "train").when(F.col("i") <= second, "validation").otherwise("test")).drop("n0", "all", "i")


def crossfit_folds(rows: DataFrame, group: str, order: str, folds: int = 5) -> DataFrame:
    """rows with fold: a group's rows stay together in two halves, and halves are dealt to folds."""
    half = F.expr(f"(2 * (row_number() over (partition by {group} order by {order}) - 1)) div count(1) over (partition by {group})")
    return rows.withColumn("half", half.cast("long")).withColumn("fold", (F.conv(F.substring(F.md5(F.concat_ws("-", group, "half").cast("binary")), 1, 7), 16, 10).cast("long") % folds))
