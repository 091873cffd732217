from pyspark.sql import functions as F

from flowlens.operators import views


def test_pages_have_totals_even_beyond_the_end(spark):
    rows = spark.createDataFrame([(k,) for k in range(7)], "id long")
    at = lambda limit, offset: [tuple(r) for r in views.page(rows, [F.col("id").desc()], limit, offset).orderBy("place").collect()]
    assert at(3, 2) == [(7, 3, 4), (7, 4, 3), (7, 5, 2)]
    assert at(3, 6) == [(7, 7, 0)] and at(3, 7) == [(7, None, None)]
    assert [tuple(r) for r in views.page(rows.where("id > 9"), [F.col("id")], 3).collect()] == [(0, None, None)]


def test_search_holds_text_case_aside(spark):
    rows = spark.createDataFrame([("0xAb1", "eth"), ("TaB", "tron"), ("x%", "tron"), (None, "tron")], "address string, chain string")
    found = lambda *a: sorted(str(r.address) for r in views.search_frozen(rows, *a).collect())
    assert found("aB") == ["0xAb1", "TaB"] and found("ab", "tron") == ["TaB"] and found("%") == ["x%"] and len(found()) == 4 and len(found("", "tron")) == 3


def test_samples_are_the_same_for_a_seed(spark):
    some = lambda letter, n: spark.createDataFrame([(f"{letter}{k % n}",) for k in range(2 * n)], "address string")
    drawn = lambda seed: sorted(tuple(r) for r in views.check_sample(some("f", 30), some("g", 4), 10, seed).collect())
    assert drawn(1) == drawn(1) != drawn(2)
    assert [sum(e == told for _, e in drawn(1)) for told in (True, False)] == [10, 4]


def test_cases_by_threat(spark):
    rows = spark.createDataFrame([(1, "A", "open", ["scam"]), (2, "A", "open", []), (3, "B", "open", None), (4, "A", "done", ["scam", "theft"])], "id int, outcome string, status string, threats array<string>")
    found = lambda **k: sorted(r.id for r in views.filter_cases(rows, **k).collect())
    assert found() == [1, 2, 3, 4] and found(threat="any") == [1, 4] and found(threat="theft") == [4] and found(outcome="A", status="open", threat="scam") == [1]
