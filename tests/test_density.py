import math
import random
from collections import defaultdict

import pytest

from flowlens.operators.density import hierarchical_clusters


def plain(points, widest, levels, min_rows, min_cluster, single=False):
    """The same rules over sets of points: cells, floods and a tree in memory."""
    grids = []
    for level in range(levels):
        cells = defaultdict(set)
        for k, at in points.items():
            cells[tuple(math.floor(v / (widest / 2**level)) for v in at)].add(k)
        dense, seen, found = {c for c, own in cells.items() if len(own) >= min_rows}, set(), []
        for start in dense:
            if start in seen:
                continue
            todo, rows = [start], set()
            seen.add(start)
            while todo:
                c = todo.pop()
                rows |= cells[c]
                near = [o for o in dense if o not in seen and all(abs(p - q) <= 1 for p, q in zip(c, o))]
                seen.update(near)
                todo += near
            found.append(frozenset(rows))
        grids.append([f for f in found if len(f) >= min_cluster])

    def grow(rows, level):
        """What a cluster gains from a grid on, and the clusters that it splits into."""
        gained = 0
        while level < levels:
            inner = [g for g in grids[level] if g <= rows]
            if len(inner) != 1:
                return gained, [best(g, level) for g in inner]
            rows, gained = inner[0], gained + len(inner[0]) * (1 if level == 0 else 2 ** (level - 1))
            level += 1
        return gained, []

    def best(rows, level):
        gained, inner = grow(rows, level + 1)
        gained += len(rows) * (1 if level == 0 else 2 ** (level - 1))
        below = sum(score for score, _ in inner)
        return (gained, [rows]) if gained >= below else (below, [x for _, part in inner for x in part])

    gained, inner = grow(frozenset(points), 0)
    if single and len(grids[0]) == 1 and gained >= sum(score for score, _ in inner):
        return {grids[0][0]}
    return {x for _, part in inner for x in part}


def blobs(r, spec):
    return [(r.gauss(x, s), r.gauss(y, s)) for x, y, s, n in spec for _ in range(n)]


def shape(name, r):
    if name == "two tight ones within a wide one":
        return blobs(r, [(0, 0, 3, 500), (-1.1, 0.2, 0.12, 200), (1.3, 0.1, 0.12, 200), (30, 30, 0.5, 150)])
    if name == "rings":
        return [(q * math.cos(a) + r.gauss(0, 0.05), q * math.sin(a) + r.gauss(0, 0.05)) for q, n in ((2, 500), (6, 1500)) for a in (r.random() * 2 * math.pi for _ in range(n))]
    return blobs(r, [(k * 5, (k % 3) * 4, 0.1 * 2 ** (k % 4), 120) for k in range(9)]) + [(r.uniform(-10, 60), r.uniform(-10, 20)) for _ in range(300)]


@pytest.mark.parametrize("name,single", [("two tight ones within a wide one", False), ("rings", False), ("rings", True), ("many densities and noise", False)])
def test_equal_to_the_plain_version(spark, name, single):
    points = dict(enumerate(shape(name, random.Random(5))))
    df = spark.createDataFrame([(k, *at) for k, at in points.items()], "id long, x double, y double")
    found = defaultdict(set)
    for row in hierarchical_clusters(df, "id", ["x", "y"], 8.0, 7, 5, 25, single).collect():
        found[row.cluster].add(row.id)
        assert (row.size == 0) == (row.cluster == "-1")
    assert sum(map(len, found.values())) == len(points)
    expected = plain(points, 8.0, 7, 5, 25, single)
    assert {frozenset(rows) for c, rows in found.items() if c != "-1"} == expected
    assert single or len(expected) >= 2


def test_dense_parts_of_a_wide_cluster_are_told_apart(spark):
    points = shape("two tight ones within a wide one", random.Random(5))
    df = spark.createDataFrame([(k, *at) for k, at in enumerate(points)], "id long, x double, y double")
    by = {row.id: row.cluster for row in hierarchical_clusters(df, "id", ["x", "y"], 8.0, 7, 5, 25).collect()}
    main = [max(set(own), key=own.count) for own in ([by[k] for k in range(500, 700)], [by[k] for k in range(700, 900)], [by[k] for k in range(900, 1050)])]
    assert len(set(main)) == 3 and "-1" not in main


def test_nothing_nulls_and_equal_rows(spark):
    kind = "id long, x double, y double"
    assert hierarchical_clusters(spark.createDataFrame([], kind), "id", ["x", "y"]).count() == 0
    rows = [(k, 1.0, 1.0) for k in range(40)] + [(k, 50.0, 1.0) for k in range(40, 80)] + [(80, None, 1.0), (81, float("nan"), 1.0), (82, 99.0, 99.0)]
    found = {r.id: (r.cluster, r["size"]) for r in hierarchical_clusters(spark.createDataFrame(rows, kind), "id", ["x", "y"]).collect()}
    assert {found[k] for k in (80, 81, 82)} == {("-1", 0)}
    assert len({found[k] for k in range(40)}) == 1 and found[0][1] == 40 and found[0] != found[40]
