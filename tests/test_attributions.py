"""Attributions of trees against Shapley's definition over all subsets of all features."""

import random
from itertools import combinations
from math import exp, factorial

import pytest

from flowlens.operators import attributions, ml

FEATURES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def fitted(spark):
    draw = random.Random(9)
    rows = []
    for k in range(600):
        x = [draw.choice([0.0, 1.0, 2.0, 3.0, draw.random()]) for _ in FEATURES]
        rows.append((k, *[None if draw.random() < 0.05 else v for v in x], int(x[0] + x[1] * x[2] > 3 or x[3] > 2.5)))
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} double" for f in FEATURES) + ", y int").repartition(3)
    model = ml.fit_trees(df, FEATURES, trees=6, depth=4)
    return df, model, {(r.tree, r.node): r for r in attributions.node_table(model).collect()}


def expected(table, at, x, known):
    """The mean of a tree's value where only known features are told: elsewhere both children, by their cover."""
    row = table[at]
    if row.feature is None:
        return row.value
    left, right = (at[0], row.left), (at[0], row.right)
    if row.feature in known:
        return expected(table, left if x[row.feature] <= row.threshold else right, x, known)
    part = table[left].cover / row.cover
    return part * expected(table, left, x, known) + (1 - part) * expected(table, right, x, known)


def test_effects_are_shapleys(spark, fitted):
    df, model, table = fitted
    roots = [at for at in table if at[1] == 0]
    assert len(roots) == 6 and len(table) > 60
    found = {r.id: r for r in attributions.tree_shap(model, df, FEATURES, "id").collect()}
    n = len(FEATURES)
    for row in df.limit(12).collect():
        x = [-1.0 if row[f] is None else row[f] for f in FEATURES]
        worth = {s: sum(expected(table, at, x, s) for at in roots) for size in range(n + 1) for s in combinations(range(n), size)}
        for j in range(n):
            others = [k for k in range(n) if k != j]
            effect = sum(
                factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n) * (worth[tuple(sorted((*s, j)))] - worth[s]) for size in range(n) for s in combinations(others, size)
            )
            assert found[row.id].effects[j] == pytest.approx(effect, abs=1e-12)
        assert found[row.id].base == pytest.approx(worth[()], abs=1e-12)


def test_effects_sum_to_the_score(fitted):
    df, model, _ = fitted
    scores = {r.id: r.p for r in ml.score_trees(model, df, FEATURES).select("id", "p").collect()}
    for r in attributions.tree_shap(model, df, FEATURES, "id").collect():
        assert r.margin == pytest.approx(r.base + sum(r.effects), abs=1e-12)
        assert scores[r.id] == pytest.approx(1 / (1 + exp(-2 * r.margin)), abs=1e-9)


def test_ranks_and_shares(fitted):
    df, model, _ = fitted
    shaped = attributions.tree_shap(model, df, FEATURES, "id")
    rows = {r.id: dict(zip(FEATURES, r.effects)) for r in shaped.collect()}
    for r in attributions.effects_by_feature(shaped, FEATURES, "id").collect():
        order = sorted(FEATURES, key=lambda f: (-abs(rows[r.id][f]), f))
        assert order[r.place - 1] == r.feature and rows[r.id][r.feature] == r.effect
    shares = {r.feature: r.share for r in attributions.global_importance(shaped, FEATURES).collect()}
    means = {f: sum(abs(x[f]) for x in rows.values()) for f in FEATURES}
    assert shares == pytest.approx({f: m / sum(means.values()) for f, m in means.items()})
