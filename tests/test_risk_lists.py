from flowlens.operators import attribution
from tests.test_operators import LABELS

EDGES = "origin string, hop int, tx_hash string, block_time timestamp, from_addr string, to_addr string, asset string, amount long, traced long"
HOLDS = "origin string, hop int, wallet string, received long, reason string, held long"


def edges(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([("O", hop, f"t{k}", datetime(2024, 1, 1), a, b, "USDT", v, v) for k, (hop, a, b, v) in enumerate(rows)], EDGES)


def addresses(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "address string")


def test_threats_scams_and_mixes_count(spark):
    out, into = edges(spark, [(1, "O", "T", 50), (1, "O", "A", 50), (2, "A", "S", 30), (2, "A", "M", 10)]), edges(spark, [(1, "F", "O", 80), (1, "T", "O", 20), (1, "Z", "O", 100)])
    labels = spark.createDataFrame([("M", "Mix", "mixer", "curated", "hot")], LABELS)
    holds = spark.createDataFrame([("O", 2, "A", 20, "coinjoin", 20)], HOLDS)
    found = attribution.indicators(out, into, holds, labels, addresses(spark), addresses(spark, "T", "F", "M", "T"), addresses(spark, "S", "T", "Z", "O"))
    told = {(r.code, r.wallet): r.points for r in found.collect()}
    # T is on both sides: a contact with half the money; M is a mixer already; F funded 40 %; T has a tag, so no scam row
    assert told == {
        ("threat_contact", "T"): 75 + 10, ("threat_funding", "F"): 55 + 6, ("scam_contact", "S"): 60, ("scam_contact", "Z"): 60, ("scam_self", "O"): 85,
        ("mixer_contact", "M"): 75 + 1, ("coinjoin_shape", "A"): 40,
    }


def test_a_wallet_alone_and_without_lists(spark):
    labels = spark.createDataFrame([("M", "Mix", "mixer", "curated", "hot")], LABELS)
    cases = spark.createDataFrame([], "origin string, code string, points int, is_pattern boolean")
    rows = attribution.wallet_risk(labels, addresses(spark), cases, addresses(spark, "M", "T"), addresses(spark, "T", "S")).collect()
    assert {r.wallet: r.score for r in rows} == {"M": 90, "T": 95, "S": 85}
    assert attribution.wallet_risk(labels, addresses(spark), cases).count() == 1
