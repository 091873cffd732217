"""How often rows are dealt anew: what a step lays out serves all that goes by the same key."""

import pytest

from flowlens.operators import flow, typologies, utxo
from flowlens.session import drop_scratch, laid_out, scratch_count


@pytest.fixture
def shuffled(spark):
    """A session without broadcasts, as over large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_flows_of_dealt_transactions_are_dealt_no_more(shuffled):
    sides = [shuffled.range(9).selectExpr("cast(id div 3 as string) txid", "cast(id as string) address", "id amount").repartition(4, "txid") for _ in range(2)]
    mixes = shuffled.createDataFrame([("1",)], "txid string")
    assert exchanges(utxo.all_flows(*sides, mixes)) <= 4


def test_flags_of_kept_edges_are_counted_where_they_are(shuffled):
    begun = scratch_count()
    edges = shuffled.range(90).selectExpr("cast(id % 7 as string) origin", "1 hop", "concat('t', id) tx_hash", "concat('w', id % 5) from_addr", "concat('v', id % 3) to_addr", "id + 1 traced")
    labels = shuffled.createDataFrame([("v1", "mixer")], "address string, category string")
    found = typologies.flags(laid_out(edges, "edges", "origin"), labels)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # what goes by the wallet's label is dealt by it, and back
    assert "Expand" not in plan and exchanges(found) <= 5
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, typologies.flags(edges, labels).collect()))
    named = [t.name for t in shuffled.catalog.listTables()]
    drop_scratch(shuffled, begun)
    assert named and not [t.name for t in shuffled.catalog.listTables() if t.name.startswith("scratch_edges")]


def test_an_origins_own_payments_are_of_one_asset(shuffled):
    level = shuffled.range(20).selectExpr("cast(id % 3 as string) origin", "concat('w', id % 4) far", "'USDT' asset", "id traced")
    rows, chosen = flow._one_asset(level, None, False)
    assert exchanges(rows) == 0 and rows.where("odd").isEmpty()
    assert chosen.count() == level.select("origin", "far").distinct().count()
