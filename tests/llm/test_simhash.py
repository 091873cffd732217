import random

import numpy as np
import pytest
import xxhash
from tests.llm.helpers import awkward, empty, lower, prose

from flowlens.llm import simhash


def slow_fingerprint(text):
    words = lower(text).split()
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "one", "One two\tTHREE", prose(4), prose(200) + "\n" + prose(200), "É é À à ß\x0bx y z"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def test_fingerprint_in_chunks(monkeypatch):
    whole = simhash.fingerprint(prose(500))
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(prose(500)) == whole


def test_links_are_all_pairs_once(spark):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:40]:
        for n in (1, 2, 3, 4, 5):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()]
    expected = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == expected


def groups(rows, prints):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) % (1 << 64)).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    base = [prose(120, s) for s in range(12)]
    rows = []
    for k in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(50)}"
        rows.append((k, " ".join(words)))
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = groups(rows, [simhash.fingerprint(t) for _, t in rows])
    least = {}
    for (i, _), g in zip(rows, found):
        least[g] = min(i, least.get(g, i))
    assert got == {i: least[g] for (i, _), g in zip(rows, found)}


def test_long_chains_end(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 600), (600, 550)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 550: 500, 600: 500}


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    empties = [r for r in rows if r.fp == 0]
    assert {r.component_id for r in empties} == {3} and len(empties) == 4
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    prints = [simhash.fingerprint(t) for t in texts]
    assert all((a ^ b) % (1 << 64) and ((a ^ b) % (1 << 64)).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    every = [simhash.fingerprint(r.text) for r in docs.collect()]
    assert len(texts) == len(set(groups(every, every)))


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0


def test_hot_copies(spark):
    rows = [(k, prose(80) if k % 3 else " ".join(f"w{k}x{j}" for j in range(30))) for k in range(300)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in found if r.doc_id % 3} == {1} and np.unique([r.doc_id for r in found]).size == 300


def test_dense_groups_and_hot_variants(spark, monkeypatch):
    rng = random.Random(9)
    prints = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(120)}
    prints |= {rng.getrandbits(64) for _ in range(40)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = groups(signed, signed)
    for hot in (2000, 4):
        monkeypatch.setattr(simhash, "HOT", hot)
        root = {r.fp: r.root for r in simhash._classes(table, 4).collect()}
        assert len(root) == len(signed)
        least = {}
        for p in signed:
            least.setdefault(root[p], p)
        assert [least[root[p]] for p in signed] == [signed[g] for g in found]
