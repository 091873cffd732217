"""Exact attributions of tree ensembles: what each feature adds to a row's score, by Shapley's rule over paths."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import scratch_path


def node_table(model: GBTClassificationModel) -> DataFrame:
    """tree, node, feature, threshold, left, right, value (times the tree's weight), cover: a row for each node of a model.

    A row goes left where its feature is at most the threshold; leaves have no feature. cover is the training rows.
    """
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "trees")
    model.write().save(path)
    weights = F.create_map(*[F.lit(x) for k, w in enumerate(model.treeWeights) for x in (k, float(w))])
    rows = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    inner = F.col("leftChild") >= 0
    return rows.select(
        "tree", F.col("id").alias("node"), F.when(inner, F.col("split.featureIndex")).alias("feature"), F.when(inner, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"), (F.col("prediction") * weights[F.col("tree")]).alias("value"),
        F.col("rawCount").cast("double").alias("cover"),
    )


@dataclass(frozen=True)
class Leaf:
    """A path's features, each once, with the range (low, high] that leads along it; value of the leaf.

    effects[pattern] has each feature's part, where bit k of the pattern says whether a row is in range k.
    """

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float
    effects: np.ndarray


def _effects(share: np.ndarray, value: float) -> np.ndarray:
    """Shapley's parts for a leaf: a known feature counts as 1 in range and 0 out of it, an unknown one as the share of
    training rows that went along the path at its splits; each subset of the other features has its weight."""
    m = len(share)
    out = np.zeros((1 << m, m))
    for pattern in range(1 << m):
        inside = [(pattern >> k) & 1 for k in range(m)]
        for j in range(m):
            others = [k for k in range(m) if k != j]
            for size in range(m):
                weight = factorial(size) * factorial(m - size - 1) / factorial(m)
                for known in combinations(others, size):
                    met = np.prod([inside[k] if k in known else share[k] for k in others])
                    out[pattern, j] += weight * met * (inside[j] - share[j]) * value
    return out


def leaves(nodes: DataFrame) -> list[Leaf]:
    """The leaves of a model's node table, which is as large as the model and no larger with the data."""
    table = {(r.tree, r.node): r for r in nodes.collect()}
    found, todo = [], [((t, n), {}) for t, n in table if n == 0]
    while todo:
        at, path = todo.pop()
        row = table[at]
        if row.feature is None:
            share = np.array([s for _, _, s in path.values()])
            low, high = (np.array([p[k] for p in path.values()]) for k in (0, 1))
            found.append(Leaf(np.array(list(path), dtype=int), low, high, share, row.value, _effects(share, row.value)))
            continue
        low, high, share = path.get(row.feature, (-np.inf, np.inf, 1.0))
        for child, bounds in ((row.left, (low, min(high, row.threshold))), (row.right, (max(low, row.threshold), high))):
            part = table[at[0], child].cover / row.cover
            todo.append(((at[0], child), {**path, row.feature: (*bounds, share * part)}))
    return found


def attribute(found: list[Leaf], features: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function from rows of features to their parts, the base last."""
    base = sum(leaf.value * float(np.prod(leaf.share)) for leaf in found)

    def parts(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), features + 1))
        out[:, -1] = base
        for leaf in found:
            values = x[:, leaf.features]
            pattern = ((values > leaf.low) & (values <= leaf.high)) @ (1 << np.arange(len(leaf.features)))
            out[:, leaf.features] += leaf.effects[pattern]
        return out

    return parts


def tree_shap(model: GBTClassificationModel, rows: DataFrame, features: list[str], key: str) -> DataFrame:
    """key, base, margin, effects (an array in the order of features): base and effects add up to the margin.

    The margin is half the log odds of the score. Null features count as -1, as in training. Each leaf adds to a row what
    its path's features are worth, looked up by which of them lead along it, so a row costs one pass over the leaves.
    """
    parts = attribute(leaves(node_table(model)), len(features))

    @F.pandas_udf("array<double>")
    def told(batch: pd.DataFrame) -> pd.Series:
        return pd.Series(list(parts(batch.to_numpy(dtype="float64"))))

    filled = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in features])
    found = rows.select(key, told(filled).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x)
    return found.select(key, F.element_at("parts", -1).alias("base"), total.alias("margin"), F.slice("parts", 1, len(features)).alias("effects"))


def effects_by_feature(shaped: DataFrame, features: list[str], key: str) -> DataFrame:
    """key, feature, effect, place: a row for each feature, by the size of its effect."""
    names = F.array(*map(F.lit, features))
    pairs = F.arrays_zip(names.alias("feature"), F.col("effects").alias("effect"))
    order = F.array_sort(pairs, lambda a, b: F.when(F.abs(a["effect"]) > F.abs(b["effect"]), -1).when(F.abs(a["effect"]) < F.abs(b["effect"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1))
    return shaped.select(key, F.posexplode(order).alias("place", "p")).select(key, "p.feature", "p.effect", (F.col("place") + 1).cast("long").alias("place"))


def global_importance(shaped: DataFrame, features: list[str]) -> DataFrame:
    """feature, share: features by the mean size of their effects, as parts of one."""
    means = [F.avg(F.abs(F.element_at("effects", k + 1))).alias(f"m{k}") for k in range(len(features))]
    rows = shaped.agg(*means).select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{k}").alias("mean")) for k, f in enumerate(features)])).alias("x")).select("x.*")
    whole = rows.agg(F.sum("mean").alias("all"))
    return rows.join(F.broadcast(whole)).select("feature", F.try_divide("mean", "all").alias("share"))
