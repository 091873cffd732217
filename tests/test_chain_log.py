from pyspark.sql import functions as F

from flowlens.operators import chain_log
from flowlens.session import written

KEY = b"k" * 32
KIND = "log string, at long, payload string"


def plain(rows, step):
    """Digests by following each log's rows one after the other."""
    out, state = {}, {}
    for log, _, payload in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        log, payload = log or "", payload or ""
        seq, prev = state.get(log, (0, None))
        if seq % step == 0:
            prev = chain_log.hashlib.sha256(f"{log}|{seq // step}".encode()).hexdigest()
        seq, prev = seq + 1, chain_log.link(prev, payload, KEY)
        state[log] = seq, prev
        out[log, seq] = prev
    return out


def made(spark, step=4):
    rows = [("a", k, f"x{k}") for k in range(30)] + [("b", k, f"y{k % 3}") for k in range(3)] + [(None, 1, None)]
    first = spark.createDataFrame([r for r in rows if r[1] < 9], KIND)
    second = spark.createDataFrame([r for r in rows if r[1] >= 9], KIND)
    kept = chain_log.append(None, first, ["at"], KEY, step)
    return rows, written(kept.unionByName(chain_log.append(kept, second, ["at"], KEY, step)), "log")


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_batches_are_one_chain(spark):
    rows, log = made(spark)
    assert {(r.log, r.seq): r.digest for r in log.collect()} == plain(rows, 4)
    assert found(chain_log.breaks(log, KEY, 4)) == []
    heads = {r.log: (r["rows"], r.levels) for r in chain_log.heads(log, KEY, 4).collect()}
    assert heads == {"a": (30, 3), "b": (3, 3), "": (1, 3)}


def test_exactly_the_break_that_is_put_in(spark):
    _, log = made(spark)
    check = lambda df: found(chain_log.breaks(df, KEY, 4))
    at = lambda seq: (F.col("log") == "a") & (F.col("seq") == seq)
    assert check(log.withColumn("payload", F.when(at(7), "forged").otherwise(F.col("payload")))) == [("a", 7, "changed")]
    assert check(log.where(~at(7))) == [("a", 7, "missing")]
    assert check(log.where(~at(8))) == [("a", 8, "missing")]
    assert check(log.where(~at(1))) == [("a", 1, "missing")]
    assert check(log.where(~((F.col("log") == "a") & F.col("seq").between(1, 8)))) == [("a", 1, "missing")]
    assert check(log.where(~((F.col("log") == "a") & F.col("seq").between(9, 12)))) == [("a", 9, "missing")]
    assert check(log.unionByName(log.where(at(6)))) == [("a", 6, "repeated")]
    assert ("a", 7, "moved") in check(log.withColumn("prev", F.when(at(7), "0").otherwise(F.col("prev"))))
    assert len(found(chain_log.breaks(log, b"another key", 4))) == log.count()
    # an end that is cut off shows against what was noted, and in the head
    noted, short = chain_log.heads(log, KEY, 4), log.where(~((F.col("log") == "a") & (F.col("seq") > 20)))
    assert check(short) == [] and found(chain_log.breaks(short, KEY, 4, noted)) == [("a", 21, "missing")]
    head = lambda df: chain_log.heads(df, KEY, 4).where("log = 'a'").first().head
    assert head(short) != noted.where("log = 'a'").first().head


def test_pages_of_the_newest(spark):
    _, log = made(spark)
    rows = chain_log.listed(log, "a", 2, 3).orderBy("place").collect()
    assert [(r.total, r.place, r.seq) for r in rows] == [(30, 4, 27), (30, 5, 26)]


def test_empty_logs(spark):
    none = chain_log.append(None, spark.createDataFrame([], KIND), ["at"], KEY, 4)
    assert none.count() == 0 and chain_log.heads(none, KEY, 4).count() == 0 and chain_log.breaks(none, KEY, 4).count() == 0
