import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.helpers import awkward, empty, lower, prose

from flowlens.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        own = words(body)
        n = min(window, len(own))
        for i in range(len(own) - n + 1) if own else ():
            for k in range(len(w) - n + 1):
                if w[k : k + n] == own[i : i + n]:
                    hit.update(range(k, k + n))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@given(st.text(st.sampled_from("aB1 é.\n"), max_size=80))
def test_words(text):
    assert [w.decode() for w in d.words(text)] == words(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", min_size=1, max_size=9), min_size=1, max_size=8), st.text("ab ", max_size=60))
def test_wu_manber_finds_every_occurrence(patterns, text):
    found = sorted(d.WuManber([p.encode() for p in set(patterns)]).occurrences(text.encode()))
    assert found == sorted((k, p.encode()) for p in set(patterns) for k in range(len(text) - len(p) + 1) if text.startswith(p, k))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "C"]), max_size=14), min_size=1, max_size=4), st.lists(st.sampled_from(["a", "b", "c"]), max_size=40))
def test_search_matches_brute_force(items, text):
    named = [(str(k), " ".join(i)) for k, i in enumerate(items)]
    n, spans, found = d.Searcher(named).search(" ".join(text))
    assert (n, sum(b - a for a, b in spans), sorted(found)) == brute(" ".join(text), named)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


ITEMS = [(11, prose(30, 4)), (2, prose(12, 8)), (3, "Short item"), (4, ""), (5, None), (None, "odd one out"), (11, "second text of one id")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_operator_in_one_and_several_blocks(spark, block_bytes):
    texts = [prose(30, 4), prose(60, 4) + " short ITEM!", "x " + prose(12, 8) + " y " + prose(11, 8), "shortitem", "a short, item", None, "", "odd one out", prose(9, 4), "second text of one id"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in d.find_contamination(docs, bench, block_bytes=block_bytes).collect()}
    named = [("" if i is None else str(i), t) for i, t in ITEMS]
    assert got == {k: brute(t, named) for k, t in enumerate(texts)}


def test_awkward_rows(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = d.find_contamination(docs, bench)
    assert out.columns == docs.columns + ["_n_words", "n_hit", "spans", "items", "contaminated"]
    named = [("" if i is None else str(i), t) for i, t in ITEMS]
    for r in out.collect():
        if len(r.text or "") < 10_000:
            assert (r["_n_words"], r.n_hit, list(r["items"])) == brute(r.text, named)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find_contamination(empty(spark), none).count() == 0
    assert d.find_contamination(awkward(spark), none).where("contaminated").count() == 0
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(",".join([]).encode()).hexdigest()
