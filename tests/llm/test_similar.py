import random

from pyspark.sql import functions as F
from tests.llm.helpers import awkward, empty, lower

import corpus_pipeline
from flowlens.llm import similar


def brute_set(text):
    words = [w for w in lower(text).split() if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The least index of each row's component of texts at five-word Jaccard of 0.8 or more."""
    sets, root = [brute_set(t) for t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


def near_copies(seed=7):
    """Texts of random words with copies whose similarity lies on both sides of 0.8, one short, and some of one template."""
    rng = random.Random(seed)
    rows = []
    for k in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 8, 45, 120, 300]))]
        if k % 4 == 0:
            base = [f"t{j}" for j in range(60)] + base
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
            rows.append(" ".join(words[: rng.choice([None, None, -3])]).upper())
    rng.shuffle(rows)
    return rows


def test_near_dedup_keeps_one_of_each_component(spark, monkeypatch):
    rows = near_copies()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")
    expected = {k for k, g in enumerate(brute(rows)) if k == g}
    assert 30 < len(expected) < len(rows) - 20
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == expected
    monkeypatch.setattr(similar, "COMMON", 1)
    monkeypatch.setattr(similar, "HOT", 3)
    assert {r.doc_id for r in similar.keep_one(docs).collect()} == expected


def test_links_across_close_groups_are_found(spark):
    """Each group's members are close; one link of just 0.8 joins two groups, another pair of groups stays apart."""
    base = [f"a{j}" for j in range(204)]
    rows = [base[:-1] + [f"c{k}"] for k in range(6)]
    far = base[:20] + [f"f{j}" for j in range(22)] + base[20:]
    rows += [far[:-1] + [f"d{k}"] for k in range(6)]
    rows += [[f"b{j}" for j in range(204)][:-1] + [f"e{k}"] for k in range(6)]
    rows = [" ".join(r) for r in rows]
    expected = {k for k, g in enumerate(brute(rows)) if k == g}
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id for r in similar.keep_one(docs).collect()} == expected == {0, 12}


def test_similarity_of_exactly_four_fifths_links(spark):
    base = [f"a{j}" for j in range(22)]
    rows = [" ".join(base), " ".join(base[:-2] + ["b", "c"]), " ".join(base[:-3] + ["b", "c", "d"])]
    assert [len(brute_set(rows[0]) & brute_set(x)) for x in rows] == [18, 16, 15]
    docs = spark.createDataFrame([(0, rows[0]), (1, rows[1])], "doc_id long, text string")
    assert similar.keep_one(docs).count() == 1
    assert similar.keep_one(spark.createDataFrame([(0, rows[0]), (2, rows[2])], "doc_id long, text string")).count() == 2


def test_awkward_rows(spark):
    docs = awkward(spark)
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in docs.collect()]
    assert kept.count() == len(set(brute(texts)))
    assert similar.keep_one(empty(spark)).count() == 0


def classes_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return docs.select("id", F.xxhash64("text").alias("mark"), F.lit(1).alias("n"), similar._signatures({})("text").alias("s")).select("id", "mark", "n", "s.*")


def test_deletion_variants_find_all_within_four_bits(spark):
    base = [f"a{j}" for j in range(400)]
    texts = [" ".join(base[:k] + [f"b{k}"] + base[k + 1 :]) for k in (0, 1, 2, 200, 399)] + [" ".join(base), " ".join(base[::-1])]
    classes = classes_of(spark, texts).cache()
    sims = {r.fp: r.sim for r in classes.collect()}
    expected = {(a, b) for a in sims for b in sims if a < b and ((sims[a] ^ sims[b]) & (1 << 64) - 1).bit_count() <= 4}
    assert 3 < len(expected) < 21
    got = [(r.a, r.b) for r in similar.within_bits(classes, classes.select("fp", F.col("fp").alias("root"))).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_keys_of_one_passage_meet_once(spark):
    """What two texts share is one key with a weight, so their pair is met once, not once for each shingle of the passage."""
    passage = [f"p{j}" for j in range(300)]
    texts = [" ".join([f"{own}{j}" for j in range(200)] + passage) for own in "xy"]
    classes = classes_of(spark, texts).cache()
    x, y = (set(r.prefix) for r in classes.collect())
    assert len(x & y) > 20
    rows = similar.shared_keys(classes, classes.select("fp", F.col("fp").alias("root"))).collect()
    assert [r.weight for r in rows] == [len(x & y)] * 2 and len({r.key for r in rows}) == 1


def test_pairs_of_large_sets_that_share_keys_but_differ_are_not_told_of(spark):
    """Some 0.7 of two large sets is the same: enough keys, but their wider bitmaps differ by more than 0.8 allows."""
    passage = [f"p{j}" for j in range(2500)]
    texts = [" ".join([f"{own}{j}" for j in range(500)] + passage) for own in "xy"] + [" ".join([f"z{j}" for j in range(20)] + passage)]
    classes = classes_of(spark, texts).cache()
    one = {r.id: r.fp for r in classes.collect()}
    rows = similar.shared_keys(classes, classes.select("fp", F.col("fp").alias("root")))
    got = {(r.a, r.b) for r in similar.candidates(rows, classes).collect()}
    assert got == {tuple(sorted((one[k], one[2]))) for k in (0, 1)}
