from flowlens.operators import attribution, flow
from tests.test_operators import LABELS, MOVES, moves


def told(spark, payments, labels, **rules):
    """Verdict of the one named service, with the address whose label is hidden."""
    rows, names = spark.createDataFrame(moves(payments), MOVES), spark.createDataFrame(labels, LABELS)
    origin, limits = spark.createDataFrame([("O",)], "origin string"), flow.Rules(**rules)
    out, holds, _ = flow.trace(rows, origin, names, limits)
    before = flow.candidates(out, names)
    top = before.where("rank = 1").select("origin", "entity").join(flow.entries(out, names), ["origin", "entity"])
    again, later, _ = flow.trace(rows, origin, names, limits, hidden=top)
    return [(r.address, r.verdict) for r in attribution.verdicts(top, before, flow.candidates(again, names, top), holds, later).collect()]


EX = ("D", "Ex", "exchange", "published_por", "deposit")
HOT = ("H", "Ex", "exchange", "published_por", "hot")
OTHER = ("P", "Other", "exchange", "published_por", "hot")


def test_the_same_service_is_still_named_behind_its_deposit(spark):
    assert told(spark, [(0, "O", "D", 1000), (1, "D", "H", 1000)], [EX, HOT]) == [("D", "holds")]


def test_another_service_does_not_count(spark):
    assert told(spark, [(0, "O", "D", 1000), (1, "D", "P", 1000)], [EX, OTHER]) == [("D", "gone")]


def test_a_small_part_that_still_comes_is_weaker(spark):
    assert told(spark, [(0, "O", "D", 900), (1, "O", "H", 100), (2, "D", "Z", 900)], [EX, HOT]) == [("D", "weaker")]


def test_what_the_second_trace_cannot_see_is_not_told(spark):
    assert told(spark, [(0, "O", "A", 1000), (1, "A", "D", 1000), (2, "D", "H", 1000)], [EX, HOT], hops=2) == [("D", "not_checked")]
