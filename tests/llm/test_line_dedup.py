import random
from collections import Counter, defaultdict

from tests.llm.helpers import awkward, empty

from flowlens.llm.line_dedup import drop_boilerplate


def brute(rows, ratio, least):
    pages, hosts = Counter(), Counter()
    for _, host, text in rows:
        hosts[host] += 1
        for line in {x.strip(" \t\r\f") for x in (text or "").split("\n")} - {""}:
            pages[host, line] += 1
    gone = {k for k, n in pages.items() if n >= least and n > ratio * hosts[k[0]]}
    out = defaultdict(list)
    for doc_id, host, text in rows:
        if not text:
            out[doc_id].append((0, 0, text))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if (host, x.strip(" \t\r\f")) not in gone]
        out[doc_id].append((len(lines), len(lines) - len(kept), "\n".join(kept) if len(kept) < len(lines) else text))
    return {k: sorted(v, key=str) for k, v in out.items()}


def found(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append((r.n_lines, r.n_dropped, r.text))
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_matches_brute_force(spark):
    rng = random.Random(3)
    lines = ["Menu", " Menu ", "", "About us", "rare"] + [f"line {k}" for k in range(30)]
    rows = [(k, rng.choice(["a", "b", None]), "\n".join(rng.choice(lines[: 5 + k % 30]) for _ in range(rng.randint(1, 8)))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert found(drop_boilerplate(docs, ratio=0.2, min_pages=4)) == brute(rows, 0.2, 4)


def test_awkward_rows_keep_their_columns(spark):
    docs = awkward(spark).withColumnRenamed("norm", "n_lines")
    cut = drop_boilerplate(docs, ratio=0.1, min_pages=1)
    assert cut.columns[: len(docs.columns)] == docs.columns and cut.count() == docs.count()
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    got = cut.drop("n_lines").withColumnRenamed("_n_lines", "n_lines")
    assert found(got) == brute(rows, 0.1, 1)


def test_page_of_boilerplate_alone_ends_empty(spark):
    rows = [(k, "h", "same line") for k in range(6)] + [(9, "h", "own")]
    cut = {r.doc_id: r.text for r in drop_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert cut == {**{k: "" for k in range(6)}, 9: "own"}


def test_empty_table(spark):
    assert drop_boilerplate(empty(spark)).count() == 0


def test_default_ratio_tells_repeated_lines_from_clean_ones(spark):
    """In a site of 600: lines planted in 2 % of its pages and up go; own lines and such as 0.5 % share by chance stay."""
    rng = random.Random(11)
    planted = {"Menu": 0.3, "Licensed under X.": 0.02, " ".join(f"w{k}" for k in range(60)): 0.03, "Read more": 0.05}
    on = {line: set(rng.sample(range(600), int(share * 600))) for line, share in planted.items()}
    clean = {f"Hello {k}": set(rng.sample(range(600), 3)) for k in range(20)}
    rows = [(k, "site", "\n".join([f"own line {k}"] + [line for line, ids in {**on, **clean}.items() if k in ids])) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    left = {line for r in drop_boilerplate(docs).collect() for line in r.text.split("\n")}
    assert left == set(clean) | {f"own line {k}" for k in range(600)}
