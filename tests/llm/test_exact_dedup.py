import hashlib
import random

import pytest
from tests.llm.helpers import awkward, empty, lower

from flowlens.llm.exact_dedup import exact_duplicates


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(lower(text), []).append(doc_id)
    out = {}
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out[hashlib.sha256(norm.encode()).hexdigest()] = (keep, len(ids), sorted(ids, key=lambda x: (x is None, x)))
    return out


def check(found, rows):
    expected = brute(rows)
    got = {}
    for r in found.collect():
        got.setdefault(r.text_sha256, []).append(r)
    assert got.keys() == expected.keys()
    for digest, members in got.items():
        keep, size, ids = expected[digest]
        assert {(m.keep_id, m.group_size) for m in members} == {(keep, size)}
        assert sorted((m.doc_id for m in members), key=lambda x: (x is None, x)) == ids
        stays = [m.doc_id for m in members if m.kept]
        assert stays == [keep]


@pytest.mark.parametrize("hot,spread", [(64, 1024), (2, 4), (1, 3)])
def test_matches_brute_force_with_hot_texts(spark, hot, spread):
    rng = random.Random(1)
    texts = ["Hot Text", "hot text", "HOT TEXT É", "hot text é", "", None] + [f"own {k} {'Z' * (k % 50)}" for k in range(40)]
    rows = [(k, texts[0] if k % 3 == 0 else rng.choice(texts)) for k in range(400)]
    check(exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), hot_rows=hot, spread=spread), rows)


@pytest.mark.parametrize("hot", [64, 1])
def test_awkward_rows(spark, hot):
    docs = awkward(spark)
    check(exact_duplicates(docs, hot_rows=hot, spread=5), [(r.doc_id, r.text) for r in docs.collect()])


def test_only_ascii_letters_fold(spark):
    docs = spark.createDataFrame([(1, "ÀB"), (2, "àb"), (3, "Àb")], "doc_id long, text string")
    assert sorted(r.doc_id for r in exact_duplicates(docs).where("kept").collect()) == [2, 3]


def test_empty_table(spark):
    found = exact_duplicates(empty(spark))
    assert found.count() == 0 and found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
