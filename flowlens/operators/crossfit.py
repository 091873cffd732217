"""Boosted trees for all folds at once: a model for each fold, trained side by side on the rows of the other folds.

Every row takes part in all models but that of its own fold. A pass over the rows sums, in each task, the gradients by
model, node, feature and bin; Spark adds the tasks' sums up, and what comes to the driver is one histogram a model and
level, whose size depends on folds, features and bins and not on the rows. So K folds cost the passes of one, and a
score of a row by its own fold's model is out of fold by construction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import written


@dataclass(frozen=True)
class Settings:
    trees: int = 30
    depth: int = 3
    rate: float = 0.2
    #: Added to the second derivatives of a leaf, and their least sum in one.
    ridge: float = 1.0
    least: float = 1.0
    bins: int = 32


@dataclass
class Tree:
    """Nodes in heap order (children of n: 2n + 1, 2n + 2); feature -1 marks a leaf. A row goes left up to the bin."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def node_of(self, binned: np.ndarray, levels: int) -> np.ndarray:
        at = np.zeros(len(binned), dtype=np.int64)
        rows = np.arange(len(binned))
        for _ in range(levels):
            f = self.feature[at]
            right = binned[rows, np.maximum(f, 0)] > self.bin[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at


@dataclass
class Models:
    """By fold: the starting margin, the weight of positives, and the trees so far."""

    folds: list[str]
    start: np.ndarray
    positive: np.ndarray
    depth: int
    trees: list[list[Tree]] = field(default_factory=list)

    def margin(self, k: int, binned: np.ndarray) -> np.ndarray:
        out = np.full(len(binned), self.start[k])
        for tree in self.trees[k]:
            out += tree.value[tree.node_of(binned, self.depth)]
        return out


def cuts(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Each feature's distinct quantiles, at most bins - 2 of them: one pass, and no labels are looked at."""
    shares = [k / (bins - 1) for k in range(1, bins - 1)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares).alias(f"c{k}") for k, c in enumerate(features)]).first()
    return [sorted(set(found[k] or [])) for k in range(len(features))]


def binned(rows: DataFrame, features: list[str], edges: list[list[float]]) -> DataFrame:
    """rows with b, the number of each feature's bin: 0 for null, else one more than the cuts below the value."""
    one = lambda c, e: F.when(F.col(c).isNull(), 0).otherwise(F.aggregate(F.array(*map(F.lit, e)) if e else F.array().cast("array<double>"), F.lit(1), lambda n, x: n + (F.col(c).cast("double") > x).cast("int")))
    return rows.withColumn("b", F.array(*[one(c, e) for c, e in zip(features, edges)]))


def _arrays(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, fold, b = (batch.column(batch.schema.get_field_index(c)) for c in ("y", "fold", "b"))
    return y.to_numpy(zero_copy_only=False), np.array(fold.to_pylist(), dtype=object), b.flatten().to_numpy(zero_copy_only=False).reshape(-1, features)


def _sums(table: DataFrame, models: Models, growing: list[Tree], level: int, features: int, bins: int) -> np.ndarray:
    """First and second derivatives by model, node of the level, feature and bin."""
    first, width, folds = 2**level - 1, 2**level, models.folds

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(folds), width, features, bins, 2))
        for batch in batches:
            y, fold, b = _arrays(batch, features)
            for k, name in enumerate(folds):
                mine = fold != name
                x, t = b[mine], y[mine]
                p = 1 / (1 + np.exp(-models.margin(k, x)))
                w = np.where(t == 1, models.positive[k], 1.0)
                node = growing[k].node_of(x, level) - first
                open_ = node >= 0
                for f in range(features):
                    at = node[open_] * bins + x[open_, f]
                    for d, values in enumerate((w * (p - t), w * p * (1 - p))):
                        sums[k, :, f, :, d] += np.bincount(at, values[open_], width * bins).reshape(width, bins)
        at = np.flatnonzero(sums.any(axis=-1))
        flat = sums.reshape(-1, 2)[at]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["at", "g", "h"])

    total = np.zeros((len(folds) * width * features * bins, 2))
    for r in table.select("fold", "y", "b").mapInArrow(local, "at long, g double, h double").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        total[r["at"]] = r.g, r.h
    return total.reshape(len(folds), width, features, bins, 2)


def _split(sums: np.ndarray, settings: Settings) -> tuple[int, int, float] | None:
    """(feature, bin, gain) of the best split of a node; the first feature and bin on ties; None if none gains."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    whole = sums[0].sum(axis=0)
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + settings.ridge)
    gain = score(left) + score(right) - score(whole)
    gain = np.where((left[..., 1] >= settings.least) & (right[..., 1] >= settings.least), gain, -np.inf)
    # sums come in any order, so gains that differ by rounding alone count as equal
    best = int(np.argmax(gain.ravel() >= gain.max() - 1e-9 * max(1.0, abs(gain.max())))) if np.isfinite(gain.max()) else -1
    return (*divmod(best, gain.shape[1]), float(gain.ravel()[best])) if best >= 0 and gain.ravel()[best] > 1e-9 else None


def fit(rows: DataFrame, features: list[str], edges: list[list[float]], settings: Settings = Settings(), folds: list[str] | None = None) -> tuple[Models, DataFrame]:
    """(models, binned rows): a model for each fold of rows (fold string, y 0 or 1, features), positives weighted up to the
    negatives of its rows. folds: only these; a name that no row has gives a model of all rows."""
    table = written(binned(rows, features, edges).withColumn("y", F.col("y").cast("double")), "binned")
    counts = {r.fold: (r.n, r.p) for r in table.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).collect()}
    folds = sorted(counts) if folds is None else folds
    n, p = (np.array([sum(v[c] for f, v in counts.items() if f != k) for k in folds], dtype=float) for c in (0, 1))
    positive = np.where(p > 0, (n - p) / np.maximum(p, 1), 1.0)
    models = Models(folds, np.zeros(len(folds)), positive, settings.depth, [[] for _ in folds])
    size = 2 ** (settings.depth + 1) - 1
    for _ in range(settings.trees):
        growing = [Tree(np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)) for _ in folds]
        for level in range(settings.depth):
            sums = _sums(table, models, growing, level, len(features), settings.bins)
            for k, tree in enumerate(growing):
                for node in range(2**level):
                    at, own = 2**level - 1 + node, sums[k, node]
                    if level and tree.feature[(at - 1) // 2] < 0:
                        continue
                    best = _split(own, settings)
                    if best is None:
                        continue
                    f, cut, _ = best
                    tree.feature[at], tree.bin[at] = f, cut
                    left, whole = own[f, : cut + 1].sum(axis=0), own[f].sum(axis=0)
                    for child, s in ((2 * at + 1, left), (2 * at + 2, whole - left)):
                        tree.value[child] = -settings.rate * s[0] / (s[1] + settings.ridge)
        for k, tree in enumerate(growing):
            models.trees[k].append(tree)
    return models, table


def scores(models: Models, table: DataFrame, features: int) -> DataFrame:
    """table's rows without b, with p by the model of their own fold; null for folds without a model."""
    kept = [f for f in table.schema.fields if f.name != "b"]
    place = {name: k for k, name in enumerate(models.folds)}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, fold, b = _arrays(batch, features)
            p = np.full(len(fold), np.nan)
            for name in set(fold) & set(place):
                mine = fold == name
                p[mine] = 1 / (1 + np.exp(-models.margin(place[name], b[mine])))
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p, mask=np.isnan(p))], names=[*(f.name for f in kept), "p"])

    schema = table.drop("b").withColumn("p", F.lit(0.0)).schema
    return table.mapInArrow(score, schema)


def crossfit(rows: DataFrame, features: list[str], settings: Settings = Settings()) -> DataFrame:
    """rows (fold, y, features and others) with p, each row's score by the model that hasn't seen its fold."""
    models, table = fit(rows, features, cuts(rows, features, settings.bins), settings)
    return scores(models, table, len(features))
