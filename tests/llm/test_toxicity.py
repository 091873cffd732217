import math
import time

import pytest
from tests.llm.helpers import awkward, empty, held_out, prose

from flowlens.llm import toxicity as X

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(
    "text,words",
    [("You IDIOT!", ["you", "idiot"]), ("1d10t m0r0n", ["idiot", "moron"]), ("іdіоt", ["idiot"]), ("id​iot", ["idiot"]), ("5tup1d", ["stupid"]), ("the year 1999, 40", ["the", "year", "1999", "40"]), ("cat$$$ dog***", ["cat", "dog"]), (None, []), ("ｉｄｉｏｔ", ["idiot"])],
)
def test_fold(text, words):
    assert X.fold(text) == words


def test_matcher_weighs_words_once_and_respects_exceptions():
    m = X.Matcher({" trash ": 2.0, " tras": 1.0, " scum ": 3.0}, ["trash can"])
    assert m.weigh("what trash") == (2.0, 1, 2)
    assert m.weigh("a trash can") == (0, 0, 3)
    assert m.weigh("trashy") == (1.0, 1, 1)
    assert m.weigh("untrash") == (0, 0, 1)
    assert m.weigh("scum scum scum") == (4.5, 3, 3)
    assert m.weigh(None) == (0, 0, 0)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = X.score_toxicity(docs, X.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    hit, clean = found[found["toxic"] == 1], found[found["toxic"] == 0]
    assert len(hit) > 100 and (hit["predicted"] == 1).mean() > 0.88 and (clean["predicted"] == 1).mean() < 0.005


def test_learned_terms_and_no_labels_of_held_out_rows(spark):
    rows = [(k, prose(30, k) + (" grubzel" if k % 2 else f" w{k}"), k % 2) for k in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    assert X.train(docs, labels).lexicon[" grubzel "] > 3
    only_held = labels.where("doc_id in (" + ",".join(str(k) for k in range(300) if held_out(k)) + ")")
    assert " grubzel " not in X.train(docs, only_held).lexicon


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, toxic int, y int")
    for model in (X.train(docs, labels), X.train(empty(spark), labels.limit(0))):
        rows = X.score_toxicity(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert len({r.score for r in rows if r.n_words == 0}) == 1
        assert X.score_toxicity(empty(spark), model).count() == 0


def brute_weigh(text, lexicon, exceptions):
    """The weight, the places and the words of a text, word by word without an automaton."""
    tokens = X.fold(text)
    phrases = [X.fold(e) for e in exceptions]
    excused = {i + k for p in phrases for i in range(len(tokens) - len(p) + 1) if tokens[i : i + len(p)] == p for k in range(len(p))}
    found = {}
    for i, word in enumerate(tokens):
        weights = [w for t, w in lexicon.items() if f" {word} ".startswith(t)]
        if weights and i not in excused:
            found.setdefault(word, []).append(max(weights))
    return sum(max(w) * (1.5 if len(w) > 1 else 1) for w in found.values()), sum(map(len, found.values())), len(tokens)


def test_query_matches_brute_force(spark):
    from flowlens.llm.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = X.train(docs, labels)
    (a, b), c = model.coefficients, model.intercept
    found = {r.doc_id: r for r in QUERIES["op6_toxicity"](spark, sf).collect()}
    assert len(found) == docs.count()
    for r in docs.collect():
        total, hits, n = brute_weigh(r.text, model.lexicon, X.EXCEPTIONS)
        x, y = math.log1p(total), math.log1p(1000 * total / n) if n else 0
        score = 1 / (1 + math.exp(-max(-50, min(50, a * x + b * y + c))))
        got = found[r.doc_id]
        assert math.isclose(got.total, total) and (got.n_hits, got.n_words, got.held_out) == (hits, n, held_out(r.doc_id))
        assert math.isclose(got.score, score) and got.predicted == int(got.score >= X.THRESHOLD)


def test_lexicon_matches_brute_force(spark):
    word = lambda k: f"grub{k % 3}zel" if k % 2 else f"calm{k % 5}"
    rows = [(k, f"u{k}a the u{k}b {word(k)} u{k}c light u{k}d", k % 2) for k in range(200)]
    rows += [(1000 + k, rows[1][1], 1) for k in range(5)]
    got = X.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    pairs = {}  # no two texts share a pair of words, but for the copies
    for k, text, y in rows:
        pairs.setdefault((text, y), []).append((k, text))
    single = [(min(v)[1], y) for (_, y), v in pairs.items()]
    sizes = [sum(y == z for _, y in single) for z in (0, 1)]
    counts = {}
    for text, y in single:
        for t in X.terms(X.fold(text)):
            counts.setdefault(t, [0, 0])[y] += 1
    least = max(3, math.ceil(math.log(2000) / -math.log(sizes[1] / sum(sizes))))
    expected = {f" {w} ": X.SEED_WEIGHT for w in X.SEED_TERMS}
    for t, (clean, toxic) in counts.items():
        weight = math.log((toxic + 0.5) / (sizes[1] + 1)) - math.log((clean + 0.5) / (sizes[0] + 1))
        if toxic >= least and weight >= X.MIN_LOG_ODDS:
            expected[t] = weight
    assert set(got) == set(expected) and all(math.isclose(got[t], expected[t]) for t in got)


def test_time_grows_with_the_text():
    m = X.Matcher({" stupid ": 3.0, " trash ": 2.0})

    def seconds(n):
        began = time.process_time()
        assert m.weigh("trash can stupid " * n) == (4.5, n, 3 * n)
        return time.process_time() - began

    small = max(0.01, seconds(5000))
    assert seconds(100_000) < 60 * small
