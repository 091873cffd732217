import hashlib
import math
import random
import re

import pytest
from tests.llm.helpers import awkward, empty

from flowlens.llm.mixing import mix, source_targets


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    budget, capped = share * sum(sizes.values()), set()
    while True:
        rest = budget - sum(cap * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and cap * sizes[s] < weight[s] * rest / free}
        if not over:
            return {s: float(cap * sizes[s]) if s in capped else weight[s] * rest / free for s in order}
        capped |= over


def brute(rows):
    """taken by row for unique ids: the source's documents in random order, over and over, up to the budget."""
    sizes = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    goal = targets(sizes)
    taken = {r[0]: 0 for r in rows}
    for source in sizes:
        own = sorted(((hashlib.md5(f"mix-{i}".encode()).hexdigest(), i, size(t)) for i, s, t in rows if s == source))
        left = math.floor(goal[source] + 0.5)
        while left > 0 and sizes[source]:
            for _, i, n in own:
                taken[i] += min(n, left)
                left -= min(n, left)
    return taken, goal


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "É", None, "big"]
    rows = [(k, rng.choice(names) if k % 3 else "big", " ".join(["w"] * rng.randint(0, 40))) for k in range(200)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    taken, goal = brute(rows)
    assert {r.doc_id: r.taken for r in got} == taken
    assert all(math.isclose(r.target, goal[r.source], rel_tol=1e-12) for r in got)
    assert all(r.taken <= 2 * r.size for r in got)


def test_reruns_agree(spark):
    docs = spark.createDataFrame([(k, f"s{k % 4}", "w " * (k % 17)) for k in range(100)], "doc_id long, source string, text string")
    first = sorted(map(tuple, mix(docs).collect()))
    assert first == sorted(map(tuple, mix(docs.repartition(7)).collect()))


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = mix(docs)
    assert out.columns == docs.columns + ["_size", "source_size", "target", "taken"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(r["_size"] == size(r.text) and 0 <= r.taken <= 2 * r["_size"] for r in rows)
    per = {}
    for r in rows:
        per.setdefault(r.source, [0, r.target])[0] += r.taken
    # rows that share an id are cut in proportion, so whole words may be short of the budget by less than their number
    assert all(abs(t - goal) < 4 for t, goal in per.values())


def test_many_sources_take_weights_by_code_point(spark):
    sizes = {f"s{k:03d}": 10 + k for k in range(50)} | {None: 5, "é": 7}
    rows = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    goal = targets(sizes)
    assert all(math.isclose(r.target, goal[r.source], rel_tol=1e-12) for r in rows)


def test_sources_without_words_and_empty_table(spark):
    rows = mix(spark.createDataFrame([(1, "a", None), (2, "b", "")], "doc_id long, source string, text string")).collect()
    assert [(r.taken, r.target) for r in rows] == [(0, 0.0)] * 2
    assert mix(empty(spark)).count() == 0
