from tests.llm.helpers import held_out, lower

from pyspark.sql import functions as F

from flowlens.llm import common
from flowlens.llm.labelled import labelled_sample

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def test_small_batches_only_lower(spark):
    before = spark.conf.get(ROWS), spark.conf.get(BYTES)
    try:
        for given, kept in ((("10000", "64m"), (common.BATCH_ROWS, common.BATCH_BYTES)), (("7", "1k"), (7, 1024)), (("0", "1g"), (common.BATCH_ROWS, common.BATCH_BYTES))):
            spark.conf.set(ROWS, given[0])
            spark.conf.set(BYTES, given[1])
            common.small_batches(spark)
            size = spark.conf.get(BYTES).lower().rstrip("b").replace("k", " 1024")
            number, _, unit = size.partition(" ")
            assert (int(spark.conf.get(ROWS)), int(number) * int(unit or 1)) == kept
    finally:
        spark.conf.set(ROWS, before[0])
        spark.conf.set(BYTES, before[1])


def test_split_and_fold_follow_their_rules(spark):
    ids = [*range(50), None, -3]
    df = spark.createDataFrame([(i, f"ÀbC {i} É") for i in ids], "doc_id long, text string")
    for r in df.select("doc_id", "text", common.held_out(F.col("doc_id")).alias("h"), common.ascii_lower(F.col("text")).alias("l")).collect():
        assert r.h == held_out(r.doc_id) and r.l == lower(r.text)


def test_labelled_sample_is_bounded_and_weighted(spark):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(3000)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("y")).unionByName(spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, y int"))
    rows = labelled_sample(docs, labels.withColumnRenamed("y", "toxic"), "toxic", 100).collect()
    assert not any(held_out(r.doc_id) for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    for y, total in ((1, 200), (0, 1800)):
        mine = [r for r in rows if r.y == y]
        assert 60 < len(mine) < 140 and abs(sum(r.weight for r in mine) - total) < 0.5 * total


def test_sieve_keeps_all_that_may_be_found(spark):
    rows = spark.range(4000).selectExpr("id", "if(id = 7, null, concat('t', id)) as text")
    hashed = F.xxhash64("text")
    found = common.written(rows.where("id % 400 = 7").select(hashed.alias("h")), "found")
    some, rest = common.sieve(rows, hashed, found)
    some, rest = [r.id for r in some.collect()], [r.id for r in rest.collect()]
    assert sorted(some + rest) == list(range(4000))
    assert set(range(7, 4000, 400)) <= set(some) and len(some) < 1000
    nothing = common.written(rows.where("false").select(hashed.alias("h")), "found")
    some, rest = common.sieve(rows, hashed, nothing)
    assert some.count() == 0 and rest.count() == 4000
