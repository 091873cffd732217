import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from tests.llm.helpers import awkward, empty, held_out

from flowlens.llm import language_id as L

SF = "/root/testdata/sf0.01/documents.parquet"
TEXTS = {"xx": ["abra cadabra", "abracadabra é"], "yy": ["banana bandana", "ananas"]}


def counted(texts):
    rows = Counter()
    for lang, ts in texts.items():
        for t in ts:
            data = np.frombuffer(t.encode(), dtype=np.uint8)
            for order in range(L.ORDER + 1):
                for g in L.grams(data, order).tolist():
                    rows[lang, order, g] += 1
    return pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["lang", "ord", "gram", "n"])


def slow_bits(texts, text):
    """Code length by walking down the contexts of each byte."""
    seen = Counter()
    for t in texts:
        data = bytes(L.ORDER) + t.encode()
        for k in range(L.ORDER, len(data)):
            for order in range(L.ORDER + 1):
                seen[data[k - order : k], data[k]] += 1
    contexts = {}
    for (c, s), n in seen.items():
        contexts.setdefault(c, {})[s] = n
    data, bits = bytes(L.ORDER) + text.encode(), 0.0
    for k in range(L.ORDER, len(data)):
        for order in range(L.ORDER, -1, -1):
            found = contexts.get(data[k - order : k])
            if not found:
                continue
            total, kinds = sum(found.values()), len(found)
            if data[k] in found:
                bits -= math.log2(found[data[k]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("text", ["abra", "banana é", "zzz q", "a", "ñandú " * 30])
def test_code_lengths_are_exact(text):
    trees = L.Trees.build(counted(TEXTS), ["xx", "yy"])
    assert np.allclose(trees.code_lengths(text), [slow_bits(TEXTS[x], text) for x in ("xx", "yy")])


def test_code_lengths_in_chunks(monkeypatch):
    trees = L.Trees.build(counted(TEXTS), ["xx", "yy"])
    whole = trees.code_lengths("abra banana " * 20)
    monkeypatch.setattr(L, "CHUNK", 7)
    assert np.allclose(trees.code_lengths("abra banana " * 20), whole)


def test_spark_counts_match(spark):
    rows = [(k, t, lang) for lang, ts in TEXTS.items() for k, t in enumerate(ts * 5)]
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(rows) if not held_out(i)]
    got = L.count_grams(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas()
    own = {}
    for _, t, lang in rows:
        own.setdefault(lang, []).append(t)
    expected = counted(own)
    key = ["lang", "ord", "gram"]
    assert got.sort_values(key).reset_index(drop=True).astype({"ord": int}).equals(expected.sort_values(key).reset_index(drop=True).astype(got.dtypes.to_dict()).astype({"ord": int}))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF)
    found = L.identify(docs, L.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(found) > 250 and (found["lang_pred"] == found["lang"]).mean() > 0.98
    assert found["score"].between(0, 1).all()


def test_held_out_rows_teach_nothing(spark):
    rows = [(k, "text of one kind", "held" if held_out(k) else "kept") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.train(docs).langs == ["kept"]


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = L.identify(docs, L.train(docs)).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[3].lang_pred == by_id[4].lang_pred == by_id[8].lang_pred == "und" and by_id[3].score == 0
    assert by_id[9].lang_pred in ("en", "de") and all(r.held_out == held_out(r.doc_id) for r in rows)


def test_ties_and_nothing_learned(spark):
    trees = L.Forest([L.Trees.build(counted({"b": ["same"], "a": ["same"]}), ["a", "b"])])
    assert trees.predict("same") == ("a", 0.5) and trees.predict("12 34") == ("und", 0.0)
    none = L.train(empty(spark))
    assert none.langs == [] and none.predict("text") == ("und", 0.0)
    assert L.identify(empty(spark), none).count() == 0


def test_many_languages_in_several_tables(spark):
    """Languages of their own letters; each table has 8 of them, and what is sent grows with their number."""
    texts = {f"l{k:02}": [" ".join(chr(0x4E00 + 40 * k + (j * i) % 37) + "a" for j in range(30)) for i in range(1, 40)] for k in range(20)}
    rows = [(i, t, lang) for i, (t, lang) in enumerate((t, lang) for lang, ts in texts.items() for t in ts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    forest = L.train(docs)
    assert forest.langs == sorted(texts) and [len(t.langs) for t in forest.trees] == [8, 8, 4]
    found = {r.doc_id: r.lang_pred for r in L.identify(docs, forest).collect()}
    assert all(found[i] == lang for i, _, lang in rows)
    flat = L.Trees.build(counted({lang: [t for i, t, x in rows if x == lang and not held_out(i)] for lang in texts}), sorted(texts))
    assert np.allclose(flat.code_lengths(rows[0][1]), forest.code_lengths(rows[0][1]), rtol=1e-4)
    assert sum(c.nbytes for t in forest.trees for c in t.costs) < 0.5 * sum(c.nbytes for c in flat.costs)
