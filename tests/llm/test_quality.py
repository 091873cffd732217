import numpy as np
from tests.llm.helpers import awkward, empty, held_out, prose

from flowlens.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_statistics_are_finite_and_bounded():
    for text in (None, "", " \n", "a", "A" * 5000, prose(2000), "### $$$ %%%", "é" * 300, "\x00\x01", "1 2 3\n\n\n4"):
        stats = Q.statistics(text)
        assert stats.shape == (Q.N_STATISTICS,) and np.isfinite(stats).all() and (abs(stats) < 20).all()
    assert not Q.statistics(" \t\n").any()


def test_isotonic_is_the_best_non_decreasing_fit():
    at, hits, weight = np.arange(6.0), np.array([1.0, 0, 2, 1, 3, 3]), np.array([2.0, 1, 4, 4, 4, 3])
    knots, chances = Q.isotonic(at, hits, weight)
    assert (np.diff(chances) >= 0).all() and np.isclose(np.interp(0, knots, chances), 1 / 3)
    assert np.isclose(np.interp(3, knots, chances), 3 / 8) and np.isclose(np.interp(5, knots, chances), 1)


def test_normal_equations_sum_over_partitions(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.train(docs, labels)
    sample = Q.labelled_sample(docs, labels, "quality", Q.PER_CLASS).toPandas()
    z = model.features(np.stack([Q.statistics(t) for t in sample["text"]]))
    w, y = sample["weight"].to_numpy(), sample["y"].to_numpy(dtype=float)
    direct = np.linalg.solve((z * w[:, None]).T @ z + Q.RIDGE * w.sum() * np.eye(z.shape[1]), (z * w[:, None]).T @ y)
    assert np.allclose(z @ direct, z @ model.coefficients, atol=1e-6)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = Q.score_quality(docs, Q.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = found[found["quality"] == 1], found[found["quality"] == 0]
    assert (good["predicted"] == 1).mean() > 0.95 and (bad["predicted"] == 0).mean() > 0.9


def test_awkward_rows_and_missing_labels(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, 1), (7, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, weight int")
    for model in (Q.train(docs, labels), Q.train(docs, labels.where("quality = 1")), Q.train(docs, labels.limit(0)), Q.train(empty(spark), labels)):
        rows = Q.score_quality(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
        by_id = {r.doc_id: r.score for r in rows if r.doc_id is not None}
        assert by_id[3] == by_id[4] == by_id[8]
        assert Q.score_quality(empty(spark), model).count() == 0
    none = Q.train(docs, labels.limit(0))
    assert {r.score for r in Q.score_quality(docs, none).collect()} == {0.5}


def test_steps_come_from_scores_of_the_other_half(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.train(docs, labels)
    sample = Q.labelled_sample(docs, labels, "quality", Q.PER_CLASS)
    sample = sample.withColumn("half", Q.F.expr("pmod(xxhash64(doc_id, 'half'), 2)")).toPandas()
    z = model.features(np.stack([Q.statistics(t) for t in sample["text"]]))
    w, y, half = sample["weight"].to_numpy(), sample["y"].to_numpy(dtype=float), sample["half"].to_numpy()
    hits, n = np.zeros(Q.BINS), np.zeros(Q.BINS)
    for k in (0, 1):
        fit, own = half != k, half == k
        ridge = np.linalg.solve((z[fit] * w[fit, None]).T @ z[fit] + Q.RIDGE * w[fit].sum() * np.eye(z.shape[1]), (z[fit] * w[fit, None]).T @ y[fit])
        place = np.clip(np.floor((np.round(z[own] @ ridge, 9) + 0.5) * (Q.BINS / 2)), 0, Q.BINS - 1).astype(int)
        np.add.at(hits, place, (w * y)[own])
        np.add.at(n, place, w[own])
    used = np.flatnonzero(n)
    knots, chances = Q.isotonic((used + 0.5) * 2 / Q.BINS - 0.5, hits[used], n[used])
    grid = np.linspace(-0.5, 1.5, 200)
    assert np.allclose(np.interp(grid, knots, chances), np.interp(grid, model.knots, model.chances), atol=0.02)


def test_query_matches_brute_force(spark):
    from flowlens.llm.catalog import QUERIES

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.train(docs, labels)
    found = {r.doc_id: r for r in QUERIES["op4_quality"](spark, SF).collect()}
    rows = docs.collect()
    scores = [float(np.interp(model.raw(Q.statistics(r.text)[None])[0], model.knots, model.chances)) for r in rows]
    assert len(found) == len(rows)
    for r, score in zip(rows, scores):
        got = found[r.doc_id]
        assert np.isclose(got.score, score, atol=1e-6) and got.predicted == int(got.score >= 0.5) and got.held_out == held_out(r.doc_id)
