import math
import random

import numpy as np
import pytest

from flowlens.functions import stats
from flowlens.operators import venn


def refit(rows, score, label):
    """The fit at the score by pooling all rows and the one that is asked for."""
    sums = {}
    for s, y in [*rows, (score, label)]:
        n, pos = sums.get(s, (0, 0))
        sums[s] = n + 1, pos + y
    order = sorted(sums)
    return stats.isotonic([sums[s][1] / sums[s][0] for s in order], [sums[s][0] for s in order])[order.index(score)]


@pytest.mark.parametrize("seed,rows,digits,per_range", [(1, 400, 3, 40), (2, 300, 1, 3), (3, 50, 5, 1), (4, 500, 2, 10_000)])
def test_equal_to_refitting_per_score(spark, seed, rows, digits, per_range):
    r = random.Random(seed)
    known = [(s := round(r.random(), digits), int(r.random() < (s if seed != 3 else 1 - s))) for _ in range(rows)]
    asked = sorted({round(r.random() * 1.2 - 0.1, digits) for _ in range(60)})
    found = venn.venn_abers(spark.createDataFrame(known, "score double, y int"), spark.createDataFrame([(s,) for s in asked], "score double"), per_range)
    got = {row.score: row for row in found.collect()}
    assert sorted(got) == asked
    for s in asked:
        p0, p1 = refit(known, s, 0), refit(known, s, 1)
        assert math.isclose(got[s].p0, p0, abs_tol=1e-12) and math.isclose(got[s].p1, p1, abs_tol=1e-12)
        assert math.isclose(got[s].p, p1 / (1 - p0 + p1), abs_tol=1e-12)


def test_rows_without_scores_and_tables_without_rows(spark):
    kind = "score double, y int, p0 string"
    empty = spark.createDataFrame([], kind)
    asked = spark.createDataFrame([(0.5, 1), (0.5, 0), (None, 1), (float("nan"), 0)], "score double, y int")
    assert [tuple(r) for r in venn.venn_abers(empty, asked).collect()] == [(0.5, 0.0, 1.0, 0.5)]
    assert venn.venn_abers(asked, empty).count() == 0
    known = spark.createDataFrame([(0.2, 0, "x"), (None, 1, "x"), (0.9, None, "x"), (float("nan"), 1, "x")], kind)
    rows = venn.intervals(known, asked).orderBy("y").collect()
    assert len(rows) == 4 and sum(r.p0 is None for r in rows) == 2
    assert {(r.p0, r.p1) for r in rows if r.p0 is not None} == {(0.0, 1.0)}


def test_report_has_bins_of_equal_size(spark):
    rows = [(k, k % 2, k / 50, k / 50, k / 50) for k in range(23)]
    found = venn.report(spark.createDataFrame(rows, "idx long, y int, p0 double, p1 double, p double"), 10).orderBy("bin").collect()
    assert [r.n for r in found] == [len(c) for c in np.array_split(np.arange(23), 10)]
    assert venn.report(spark.createDataFrame(rows[:4], "idx long, y int, p0 double, p1 double, p double"), 10).count() == 4
