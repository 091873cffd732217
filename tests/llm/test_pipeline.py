"""The pipeline against the plain functions of its operators, row by row in Python."""

import numpy as np
import pytest
from tests.llm.helpers import empty
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_line_dedup import brute as cut_lines
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_similar import brute as groups

import corpus_pipeline
from flowlens.llm import line_dedup, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")}


def test_whole_pipeline_matches_brute_force(spark, tables):
    docs = tables["documents"].collect()
    model = quality.train(tables["documents"], tables["labels"])
    scores = model.score(np.stack([quality.statistics(r.text) for r in docs]))
    docs = [r.asDict() for r, s in zip(docs, scores) if s >= quality.THRESHOLD]
    lines = cut_lines([(r["doc_id"], r["source"], r["text"]) for r in docs], line_dedup.RATIO, line_dedup.MIN_PAGES)
    for r in docs:
        r["text"] = lines[r["doc_id"]][0][2]
    docs.sort(key=lambda r: r["doc_id"])
    found = groups([r["text"] for r in docs])
    docs = [r for k, r in enumerate(docs) if found[k] == k]
    items = [(str(r.item_id), r.text) for r in tables["benchmark"].collect()]
    docs = [r for r in docs if contaminated(r["text"], items)[1] == 0]
    taken, _ = mixed([(r["doc_id"], r["source"], r["text"]) for r in docs])
    expected = {r["doc_id"]: (r["text"], taken[r["doc_id"]]) for r in docs if taken[r["doc_id"]]}
    assert {r.doc_id: (r.text, r.taken) for r in corpus_pipeline.run(spark, SF).collect()} == expected
    assert 50 < len(expected) < 200


def test_stages_keep_the_columns_and_live_through_empty_tables(spark):
    docs = empty(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_stages_on_awkward_rows(spark):
    from tests.llm.helpers import awkward

    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
