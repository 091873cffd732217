"""All folds at once against one fold after the other."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import crossfit

FEATURES = ["a", "b", "c"]
SETTINGS = crossfit.Settings(trees=4, depth=3, bins=12)


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(12)
    out = []
    for k in range(900):
        x = [draw.random() if draw.random() > 0.05 else None for _ in FEATURES]
        y = int((x[0] or 0) + (x[1] or 0) * (x[2] or 0) + draw.gauss(0, 0.1) > 0.8)
        out.append((k, f"f{draw.randrange(4)}", y, *x))
    return spark.createDataFrame(out, "id long, fold string, y int, a double, b double, c double").repartition(3)


def test_one_pass_is_one_fold_after_the_other(rows):
    edges = crossfit.cuts(rows, FEATURES, SETTINGS.bins)
    together = {r.id: (r.fold, r.p) for r in crossfit.crossfit(rows, FEATURES, SETTINGS).collect()}
    for fold in ("f0", "f2"):
        others = rows.where(F.col("fold") != fold)
        models, _ = crossfit.fit(others, FEATURES, edges, SETTINGS, folds=["none"])
        mine = crossfit.binned(rows.where(F.col("fold") == fold), FEATURES, edges)
        for r in mine.collect():
            p = 1 / (1 + np.exp(-models.margin(0, np.array([r.b]))[0]))
            assert together[r.id] == (fold, pytest.approx(p, abs=1e-9))
    assert len(together) == 900


def test_trees_are_those_of_a_plain_version(rows):
    """The first tree of a model over all rows, grown over whole arrays."""
    edges = crossfit.cuts(rows, FEATURES, SETTINGS.bins)
    models, table = crossfit.fit(rows, FEATURES, edges, crossfit.Settings(trees=1, depth=2, bins=12), folds=["none"])
    data = table.collect()
    b, y = np.array([r.b for r in data]), np.array([r.y for r in data])
    w = np.where(y == 1, (y == 0).sum() / y.sum(), 1.0)
    g, h = w * (0.5 - y), w * 0.25
    tree = models.trees[0][0]
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    nodes = {0: np.ones(len(y), dtype=bool)}
    for at in (0, 1, 2):
        mine = nodes[at]
        best = max(
            (score(mine & (b[:, f] <= c)) + score(mine & (b[:, f] > c)) - score(mine), -f, -c)
            for f in range(3)
            for c in range(11)
            if min(h[mine & (b[:, f] <= c)].sum(), h[mine & (b[:, f] > c)].sum()) >= 1
        )
        assert (tree.feature[at], tree.bin[at]) == (-best[1], -best[2])
        side = b[:, -best[1]] <= -best[2]
        nodes[2 * at + 1], nodes[2 * at + 2] = mine & side, mine & ~side
    for leaf in range(3, 7):
        assert tree.value[leaf] == pytest.approx(-0.2 * g[nodes[leaf]].sum() / (h[nodes[leaf]].sum() + 1))


def test_scores_tell_positives(rows):
    found = crossfit.crossfit(rows, FEATURES, SETTINGS).select("y", "p").collect()
    good = [r.p for r in found if r.y == 1]
    bad = [r.p for r in found if r.y == 0]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.93


def test_awkward_rows(spark):
    """A feature that is always null, one class only, one fold only, no rows."""
    rows = spark.createDataFrame([(1, "x", 1, None, 1.0, 2.0), (2, "x", 1, None, 1.0, 2.0)], "id long, fold string, y int, a double, b double, c double")
    assert [r.p for r in crossfit.crossfit(rows, FEATURES, SETTINGS).collect()] == [0.5, 0.5]
    assert crossfit.crossfit(rows.where("false"), FEATURES, SETTINGS).count() == 0
