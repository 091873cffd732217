"""Which payments the search for fans is given."""

from flowlens.operators import attribution, typologies


def test_only_crowded_senders_are_looked_at_for_fans(spark, monkeypatch):
    paid = lambda who, k, day, hour: ("o", 1, f"{who}{k}", f"2026-01-{day:02d} {hour:02d}:00:00", who, f"{who}to{k}", "USDT", 500, 500)
    most = typologies.FAN_OUT
    # half of them before midnight and half after; and one payment a day
    rows = [paid("a", k, 1 + 2 * k // most, 22 if 2 * k < most else 3) for k in range(most)] + [paid("b", k, 1 + k, 1) for k in range(most)]
    edges = spark.createDataFrame(rows, "origin string, hop int, tx_hash string, block_time string, from_addr string, to_addr string, asset string, amount long, traced long")
    edges = edges.withColumn("block_time", edges.block_time.cast("timestamp_ntz"))
    seen, real = [], typologies.fan_out
    monkeypatch.setattr(typologies, "fan_out", lambda payments: seen.extend(r.sender for r in payments.collect()) or real(payments))
    found = attribution.patterns(edges, edges.where("false"))
    assert {(r.code, r.wallet) for r in found.where("code = 'fan_out'").collect()} == {("fan_out", "a")}
    assert set(seen) == {"o>a"}
