"""Models on DataFrames: boosted trees with reasons, novelty, fusion with rules."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import PCA, RobustScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.graph import components
from flowlens.session import written


def fit_trees(rows: DataFrame, features: list[str], label: str = "y", trees: int = 20, depth: int = 4, seed: int = 7) -> GBTClassificationModel:
    """Boosted trees with positives weighted up to the negatives; null features count as -1."""
    filled = rows.select(F.col(label).cast("double").alias("label"), *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in features])
    share = filled.agg(F.avg("label")).first()[0] or 0.5
    weighted = filled.withColumn("weight", F.when(F.col("label") == 1, (1 - share) / max(share, 1e-9)).otherwise(F.lit(1.0)))
    vectors = VectorAssembler(inputCols=features, outputCol="features").transform(weighted)
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, weightCol="weight").fit(vectors.select("features", "label", "weight"))


def score_trees(model: GBTClassificationModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with p."""
    filled = rows.withColumn("features", array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in features])))
    scored = model.transform(filled).withColumn("p", F.element_at(vector_to_array("probability"), 2))
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def importance(model: GBTClassificationModel, features: list[str]) -> list[tuple[str, float]]:
    """Features by their share of the gain, largest first."""
    return sorted(((f, float(v)) for f, v in zip(features, model.featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


def fuse(rule: Column, p: Column, weight: float = 0.9) -> Column:
    """The stronger of a rule's confidence and a model's."""
    return F.round(F.greatest(F.coalesce(rule, F.lit(0.0)), weight * F.coalesce(p, F.lit(0.0))), 4)


class Forest:
    """An isolation forest over a bounded sample: how few random cuts set a point apart."""

    def __init__(self, sample: np.ndarray, trees: int = 100, size: int = 256, seed: int = 7) -> None:
        random = np.random.default_rng(seed)
        self.size = min(size, len(sample))
        depth = max(1, int(np.ceil(np.log2(max(2, self.size)))))
        self.trees = [self._grow(sample[random.choice(len(sample), self.size, replace=False)], depth, random) for _ in range(trees)]

    @staticmethod
    def _path(n: float) -> float:
        """The mean depth of an unsuccessful search among n."""
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n > 1)

    def _grow(self, rows: np.ndarray, depth: int, random: np.random.Generator):
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if depth == 0 or len(rows) <= 1 or not len(open_):
            return self._path(len(rows))
        at = int(random.choice(open_))
        cut = random.uniform(low[at], high[at])
        left = rows[:, at] < cut
        return at, cut, self._grow(rows[left], depth - 1, random), self._grow(rows[~left], depth - 1, random)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for tree in self.trees:
            waiting = [(tree, np.arange(len(rows)), 0)]
            while waiting:
                node, own, depth = waiting.pop()
                if not len(own):
                    continue
                if not isinstance(node, tuple):
                    total[own] += depth + node
                    continue
                at, cut, low, high = node
                left = rows[own, at] < cut
                waiting += [(low, own[left], depth + 1), (high, own[~left], depth + 1)]
        return 2 ** (-total / len(self.trees) / max(self._path(self.size), 1e-9))


def novelty(rows: DataFrame, vector: str, sample_rows: int = 5000) -> DataFrame:
    """rows with novelty, 0 to 1 between the first and the 99th percentile: how unlike the others a vector is.

    Scaled by medians and quartiles; the forest is grown from a bounded sample picked by a hash, and scores all rows.
    """
    vectors = rows.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    scaled = RobustScaler(inputCol="__v", outputCol="__s", withCentering=True).fit(vectors).transform(vectors).withColumn("__a", vector_to_array("__s"))
    share = min(1.0, sample_rows / max(1, rows.count()))
    sample = scaled.where(F.pmod(F.xxhash64(vector), F.lit(1 << 20)) < share * (1 << 20)).select("__a").toPandas()  # about sample_rows
    if not len(sample):
        return rows.withColumn("novelty", F.lit(0.0))
    forest = Forest(np.stack(sample["__a"].to_list()))

    def score(values: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.stack(values.to_list())) if len(values) else [], dtype="float64")

    raw = scaled.withColumn("raw", F.pandas_udf(score, T.DoubleType())(F.col("__a")))
    ends = raw.agg(F.percentile_approx("raw", [0.01, 0.99], 10_000).alias("q"))
    low, high = F.col("q")[0], F.col("q")[1]
    clipped = F.least(F.greatest((F.col("raw") - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return raw.join(F.broadcast(ends)).withColumn("novelty", F.coalesce(F.round(clipped, 6), F.lit(0.0))).select(*rows.columns, "novelty")


def projected(rows: DataFrame, key: str, vector: str, parts: int = 2) -> DataFrame:
    """(key, c1 to c<parts>): the leading principal components of scaled vectors, each in units of its quartile range."""
    found = rows.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v0"))
    steps = [RobustScaler(inputCol="v0", outputCol="v1", withCentering=True), PCA(k=parts, inputCol="v1", outputCol="v2"), RobustScaler(inputCol="v2", outputCol="v3", withCentering=True)]
    for step in steps:
        found = step.fit(found).transform(found)
    return found.withColumn("at", vector_to_array("v3")).select(key, *[F.col("at")[k].alias(f"c{k + 1}") for k in range(parts)])


def density_clusters(rows: DataFrame, key: str, at: list[str], width: float = 0.25, min_rows: int = 5, min_cluster: int = 25) -> DataFrame:
    """(key, cluster, size): dense regions of the space that the columns `at` span, a row per row; noise is '-1', size 0.

    Space is cut into cells. Cells of min_rows rows are dense and dense cells that touch are one cluster; a sparse cell
    goes with the fullest dense cell that it touches, of equal ones the last; clusters below min_cluster rows are noise,
    and so are rows with a null or NaN. Only cells meet each other, so a crowded cell costs what any other does.
    """
    whole = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in at]
    cell = F.array(*[F.floor(v / width).cast("long") for v in whole])
    placed = written(rows.select(key, F.when(~F.exists(cell, lambda x: x.isNull()), cell).alias("cell")), "placed")
    cells = written(placed.where("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cells")
    shifts = [F.array(*[F.col("cell")[k] + F.lit(step) for k, step in enumerate(way)]) for way in product((-1, 0, 1), repeat=len(at))]
    touching = cells.select("cell", "n", F.explode(F.array(*shifts)).alias("other"))
    dense = F.col("n") >= min_rows
    full = cells.where(dense).select(F.col("cell").alias("other"), F.col("n").alias("other_n"))
    linked = touching.where(dense & (F.col("cell") < F.col("other"))).join(full, "other").select(F.col("cell").alias("a"), F.col("other").alias("b"))
    roots = components(linked)
    named = full.join(roots, F.col("other") == F.col("node"), "left").select("other", "other_n", F.coalesce("root", "other").alias("root"))
    named = written(named, "dense")
    aside = touching.where(~dense).join(named, "other").groupBy("cell", "n").agg(F.max_by("root", F.struct("other_n", "other")).alias("root"))
    members = written(aside.unionByName(named.select(F.col("other").alias("cell"), F.col("other_n").alias("n"), "root")), "members")
    sizes = members.groupBy("root").agg(F.sum("n").alias("size")).where(F.col("size") >= min_cluster)
    known = written(members.join(sizes, "root").select("cell", F.array_join("root", ",").alias("cluster"), "size"), "clusters")
    return placed.join(known, "cell", "left").select(key, F.coalesce("cluster", F.lit("-1")).alias("cluster"), F.coalesce("size", F.lit(0)).alias("size"))


def reasons(model: GBTClassificationModel, rows: DataFrame, features: list[str], key: str, top: int = 3) -> DataFrame:
    """key, rank, feature, effect: the features that move a row's score most from what it would be with their median.

    Every row becomes one row a feature, with that feature at its median, so the model runs over them once.
    """
    filled = rows.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in features])
    middle = F.broadcast(filled.agg(*[F.percentile_approx(c, 0.5).alias(f"__{c}") for c in features]))
    names = F.explode(F.array(F.lit(""), *map(F.lit, features))).alias("__without")
    wide = filled.select("*", names).join(middle)
    wide = wide.select(key, "__without", *[F.when(F.col("__without") == c, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in features])
    scored = score_trees(model, wide, features)
    whole = F.max(F.when(F.col("__without") == "", F.col("p"))).over(W.partitionBy(key))
    moved = scored.withColumn("effect", whole - F.col("p")).where("__without <> ''")
    order = W.partitionBy(key).orderBy(F.abs("effect").desc(), "__without")
    ranked = moved.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select(key, "rank", F.col("__without").alias("feature"), F.round("effect", 6).alias("effect"))
