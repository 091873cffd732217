"""What lies beneath owners, against plain Python, and how often its rows are dealt and written."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowlens import session
from flowlens.operators import owners
from flowlens.plans import q_graph
from tests.test_oracles import SF

SCHEMA = "txid string, ts timestamp, inputs array<string>, outputs array<struct<address: string, amount: long>>, mix boolean"
SCRIPTS = ["bc1p", "bc1q", "1", "3"]


def kind(address):
    return next((s for s in SCRIPTS if address and address.startswith(s)), None)


def drawn(seed, n=90):
    """Transactions whose addresses are spent and paid, some of none, some in one hand by several of them."""
    draw = random.Random(seed)
    address = lambda: draw.choice([None, *[f"{s}{draw.randrange(50)}" for s in SCRIPTS]]) if draw.random() < 0.9 else f"{draw.choice(SCRIPTS)}{draw.randrange(3)}"
    rows = []
    for k in range(n):
        ins, outs = [address() for _ in range(draw.choice([0, 1, 1, 2, 3]))], [(address(), draw.randrange(9)) for _ in range(draw.choice([0, 1, 2, 2, 3, 7]))]
        rows.append((f"{draw.choice(SCRIPTS)}{k}", datetime(2026, 1, 1) + timedelta(days=draw.randrange(6)), ins, outs, draw.choice([True, False, False, False, None])))
    return rows


def plain(rows):
    """{owner's least address: (its addresses, {(ts, txid)}, {(address, txid, kind)})}."""
    first = {}
    for txid, ts, _, outs, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        for a, _ in outs:
            first.setdefault(a, txid)
    root = {a: a for _, _, ins, outs, _ in rows for a in [*ins, *(o for o, _ in outs)] if a}

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    def merge(a, b):
        a, b = sorted((top(a), top(b)))
        root[b] = a

    for txid, _, ins, outs, mix in rows:
        if mix or not ins or not ins[0]:
            continue
        for a in filter(None, ins):
            merge(ins[0], a)
        fresh = [a for a, _ in outs if a and first[a] == txid and kind(a) == kind(ins[0])]
        if 2 <= len(outs) <= 6 and len(fresh) == 1:
            merge(ins[0], fresh[0])
    found = defaultdict(lambda: (set(), set(), set()))
    for a in root:
        found[top(a)][0].add(a)
    for txid, ts, ins, outs, _ in rows:
        for a, what in [*((a, "spends") for a in ins), *((a, "pays") for a, _ in outs)]:
            if a:
                found[top(a)][1].add((ts, txid))
                found[top(a)][2].add((a, txid, what))
    return found


@pytest.mark.parametrize("seed", range(2))
def test_what_lies_beneath_owners(spark, seed):
    rows = drawn(seed)
    beneath = owners.beneath(spark.createDataFrame(rows, SCHEMA), F.col("mix")).cache()
    found, links = owners.expand(beneath, max_addresses=3, max_txs=2)
    expected, drawn_links = [], []
    for entity, (addresses, txs, met) in plain(rows).items():
        few, seen = sorted(addresses)[:3], [t for _, t in sorted(txs)[:2]]
        expected.append((entity, len(addresses), len(txs), ",".join(few), ",".join(seen), len(addresses) > 3 or len(txs) > 2))
        drawn_links += [(entity, *m) for m in met if m[0] in few and m[1] in seen]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert sorted(map(tuple, links.collect())) == sorted(drawn_links)
    owned = owners.resolve(spark.createDataFrame(rows, SCHEMA), F.col("mix"))
    assert sorted(map(tuple, owned.collect())) == sorted((a, e, len(v[0])) for e, v in plain(rows).items() for a in v[0])


def test_mixes_by_name_or_by_flag(spark):
    rows = drawn(9)
    txs = spark.createDataFrame(rows, SCHEMA)
    mixes = txs.where("mix").select("txid")
    for made in (owners.merges, owners.resolve):
        named, flagged = (sorted(map(tuple, made(txs.drop("mix") if isinstance(m, type(txs)) else txs, m).collect())) for m in (mixes.union(mixes), F.col("mix")))
        assert named == flagged and named


@pytest.mark.parametrize("query", ["expand_entity", "entity_links"])
def test_addresses_are_dealt_once(spark, query):
    """No table of all addresses or of all that they do is written, and an owner's rows are dealt once."""
    before, begun = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), session.scratch_count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = getattr(q_graph, query)(spark, SF)
        rows = [spark.read.parquet(path).count() for path in session._SCRATCH[begun:]]
        lines, orders = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("lineitem", "orders"))
        assert sum(rows) < 1.5 * (lines + orders)
        # dealt by transaction, by what is shared, by address (the change), by owner
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        session.drop_scratch(spark, begun)


def test_an_owners_rows_are_sorted_where_they_are(spark):
    """Owners and links come from one layout of the rows, without tables of lists by owner in memory."""
    at = lambda day: datetime(2026, 1, day)
    rows = [("t1", False, ["b", "a", None], "t1", at(2), "spends"), ("t1", False, ["c"], "t0", at(3), "pays"), ("t1", False, ["a"], "t2", at(1), "pays"), ("t1", True, ["t1"], "t2", at(1), "pays")]
    beneath = spark.createDataFrame(rows, "owner string, alone boolean, addresses array<string>, txid string, ts timestamp, kind string")
    found, links = owners.expand(beneath, max_addresses=2, max_txs=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect())) == [("a", 3, 3, "a,b", "t2,t1", True), ("t1", 1, 1, "t1", "t2", False)]
    assert sorted(map(tuple, links.collect())) == [("a", "a", "t1", "spends"), ("a", "a", "t2", "pays"), ("a", "b", "t1", "spends"), ("t1", "t1", "t2", "pays")]
