"""Traces across bridges and through transactions of many parties, and owners of addresses, against plain Python."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowlens.operators import flow, graph, owners, utxo

START = datetime(2026, 1, 1)
MOVES = "tx_hash string, block_time timestamp, from_addr string, to_addr string, asset string, amount long"
LABELS = "address string, entity string, category string, tier string, kind string"


def conserved(edges, holds, start):
    """Of each origin all that it sent is held somewhere."""
    held = {r.origin: r.s for r in holds.groupBy("origin").agg(F.sum("held").alias("s")).collect()}
    assert held == start


@pytest.fixture(scope="module")
def bridged(spark):
    """One wallet, eight deposits at a bridge, each of another fate, and what the money does on the other chain."""
    day = lambda n: START + timedelta(days=n)
    fates = ["good", "none", "elsewhere", "unpaid", "coin", "split", "usdt", "small"]
    sizes = [1_000_000, 500_000, 400_000, 300_000, 200_000, 600_000, 150_000, 5_000]
    moves = [(f"d-{f}", day(k), "a", "bridge", "USDC", n) for k, (f, n) in enumerate(zip(fates, sizes))]
    moves += [
        ("p-good", day(10), "b:pool", "b:me", "USDC", 990_000),
        ("p-coin", day(10), "b:pool", "b:me", "COIN", 7),
        ("p-split", day(11), "b:pool", "b:me", "USDC", 400_000),
        ("p-split", day(11), "b:other", "b:me", "USDC", 199_000),
        ("p-usdt", day(12), "b:pool", "b:me", "USDT", 149_000),
        ("p-small", day(12), "b:pool", "b:me", "USDC", 4_900),
        ("out1", day(10) + timedelta(hours=5), "b:me", "b:exchange", "USDC", 700_000),
        ("out2", day(13), "b:me", "b:friend", "USDC", 500_000),
        ("out3", day(13), "b:me", "b:friend", "USDT", 140_000),
        ("early", day(9), "b:me", "b:friend", "USDC", 100),
    ]
    there = {"good": "b", "elsewhere": None, "unpaid": "b", "coin": "b", "split": "b", "usdt": "b", "small": "b"}
    matches = [(f"d-{f}", "bridge", to, f"p-{f}", "b:me") for f, to in there.items()]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    labels = df([("bridge", "Bridge", "bridge", "explorer_tag", "hot"), ("b:exchange", "Ex", "exchange", "explorer_tag", "hot")], LABELS)
    bridges = flow.Bridges(df([("bridge",)], "wallet string"), df(matches, "tx_hash string, wallet string, to_chain string, payout_tx string, recipient string"))
    return flow.trace_across(df(moves, MOVES), df([("a",)], "origin string"), labels, bridges=bridges), sum(sizes)


def test_fates_of_deposits(bridged):
    (_, _, _, legs), _ = bridged
    found = {r.tx_hash: (r.status, r.reason, r.out) for r in legs.collect()}
    assert found == {
        "d-good": ("followed", None, 990_000), "d-none": ("unresolved", "no_match", None), "d-elsewhere": ("not_traced", "other_chain", None),
        "d-unpaid": ("not_traced", "no_payout", None), "d-coin": ("not_traced", "asset_changed", None), "d-split": ("followed", None, 599_000),
        "d-usdt": ("followed", None, 149_000), "d-small": ("unresolved", "small", None),
    }


def test_money_goes_on_behind_the_bridge(bridged):
    (edges, holds, _, _), total = bridged
    drawn = {(r.hop, r.tx_hash, r.from_addr, r.to_addr): r.traced for r in edges.collect()}
    assert drawn[2, "p-good", "bridge", "b:me"] == 990_000 and drawn[2, "p-split", "bridge", "b:me"] == 599_000
    assert drawn[3, "out1", "b:me", "b:exchange"] == 700_000 and drawn[3, "out2", "b:me", "b:friend"] == 500_000
    assert not any(tx in ("early", "out3", "p-small", "p-coin") for _, tx, _, _ in drawn)
    held = Counter()
    for r in holds.collect():
        held[r.wallet, r.reason] += r.held
    assert held["bridge", "bridge_fee"] == 10_000 + 1_000 + 1_000
    assert held["b:me", "asset_changed"] == 149_000 and held["b:me", "kept"] == 990_000 + 599_000 - 1_200_000
    assert held["bridge", "labelled"] == 500_000 + 400_000 + 300_000 + 200_000 + 5_000
    conserved(edges, holds, {"a": total})


def drawn_transactions(seed, n=40):
    draw = random.Random(seed)
    names = [f"w{k}" for k in range(12)] + [None]
    inputs, outputs, times = [], [], []
    for k in range(n):
        funders, payees = [draw.choice(names) for _ in range(draw.choice([1, 1, 1, 2, 4, 6]))], [draw.choice(names) for _ in range(draw.randint(1, 5))]
        paid = [draw.choice([0, 500, 500, draw.randint(100, 9999)]) for _ in payees]
        puts = [draw.randint(0, 9999) for _ in funders]
        puts[0] += max(0, sum(paid) - sum(puts)) + draw.randint(0, 300)
        inputs += [(f"t{k:03}", a, v) for a, v in zip(funders, puts)]
        outputs += [(f"t{k:03}", a, v) for a, v in zip(payees, paid)]
        times.append((f"t{k:03}", START + timedelta(hours=draw.randrange(300))))
    return inputs, outputs, times, [(f"t{k:03}",) for k in range(0, n, 9)]


def plain_flows(inputs, outputs, mixes, own):
    rows = []
    for tx in sorted({r[0] for r in inputs}):
        put, paid = Counter(), Counter()
        for _, a, v in (r for r in inputs if r[0] == tx):
            put[a] += v
        for _, a, v in (r for r in outputs if r[0] == tx):
            paid[a] += v
        funders = [a for a in put if a]
        equal = max(Counter(v for t, a, v in outputs if t == tx and a).values(), default=0)
        for me in funders:
            if not put[me]:
                continue
            shares = {to: v * put[me] // sum(put.values()) for to, v in paid.items()}
            left = {to: v for to, v in shares.items() if to != me and v}
            if not left:
                continue
            certain = len(funders) == 1 or len(left) == 1
            joint = equal >= 2 and len(funders) >= equal
            if (tx,) in mixes:
                rows.append((tx, me, f"coinjoin:{tx}", sum(left.values())))
            elif not certain and not (own and len(funders) < 5 and not joint):
                rows.append((tx, me, f"pooled:{tx}", sum(left.values())))
            else:
                rows += [(tx, me, to or f"no-address:{tx}", v) for to, v in left.items()]
            fee = put[me] - sum(shares.values())
            if fee:
                rows.append((tx, me, f"fee:{tx}", fee))
    return sorted(rows)


@pytest.mark.parametrize("own", [False, True])
def test_flows_of_many_parties(spark, own):
    inputs, outputs, _, mixes = drawn_transactions(7)
    sides = [spark.createDataFrame(rows, "txid string, address string, amount long") for rows in (inputs, outputs)]
    found = utxo.flows(*sides, spark.createDataFrame(mixes, "txid string"), own)
    assert sorted((r.tx_hash, r.from_addr, r.to_addr, r.amount) for r in found.collect()) == plain_flows(inputs, outputs, mixes, own)


def test_payments_of_a_transaction_are_served_together(spark):
    """Plain allocation by transaction, with parts by largest remainder: no unit is lost, and no payment gets too much."""
    draw = random.Random(2)
    rows = []
    for k in range(60):
        wallet, at = f"w{k % 5}", draw.randrange(100)
        if draw.random() < 0.5:
            rows.append(("o", wallet, f"in{k}", at, True, draw.randint(0, 50), "x"))
        else:
            rows += [("o", wallet, f"out{k}", at, False, draw.choice([0, 1, 7, 7, 30]), f"f{j}") for j in range(draw.randint(1, 4))]
    events = spark.createDataFrame([(*r, r[3] // 20) for r in rows], "origin string, wallet string, tx_hash string, at long, is_in boolean, amount long, far string, span long")
    found = {(r.tx_hash, r.far): r["take"] for r in flow._together(events).collect()}
    pools, expected = defaultdict(int), {}
    groups = defaultdict(list)
    for r in rows:
        groups[r[1], r[3], not r[4], r[2]].append(r)
    for (wallet, _, leaves, tx), group in sorted(groups.items(), key=lambda g: (g[0][0], g[0][1], g[0][2], g[0][3])):
        if not leaves:
            pools[wallet] += sum(r[5] for r in group)
            continue
        want = sum(r[5] for r in group)
        give = min(want, pools[wallet])
        pools[wallet] -= give
        parts = {r[6]: give * r[5] // want if want else 0 for r in group}
        order = sorted(group, key=lambda r: (-(give * r[5] % want if want else 0), r[6]))
        for r in order[: give - sum(parts.values())]:
            parts[r[6]] += 1
        expected |= {(tx, far): n for far, n in parts.items()}
    assert found == expected


def test_traces_of_many_parties_lose_nothing(spark):
    inputs, outputs, times, mixes = drawn_transactions(11, 120)
    sides = [spark.createDataFrame(rows, "txid string, address string, amount long") for rows in (inputs, outputs)]
    at = spark.createDataFrame(times, "tx_hash string, block_time timestamp")
    moves, own = (utxo.flows(*sides, spark.createDataFrame(mixes, "txid string"), mine).join(at, "tx_hash").withColumn("asset", F.lit("BTC")) for mine in (False, True))
    labels = spark.createDataFrame([("w3", "Ex", "exchange", "explorer_tag", "hot")], LABELS)
    edges, holds, _, _ = flow.trace_across(moves, own.select(F.col("from_addr").alias("origin")).distinct(), labels, flow.Rules(dust=1), own_moves=own)
    start = Counter()
    for tx, me, to, v in plain_flows(inputs, outputs, mixes, True):
        if not to.startswith("fee:"):
            start[me] += v
    conserved(edges, holds, dict(start))
    reasons = {r.reason for r in holds.select("reason").distinct().collect()}
    assert {"fee", "coinjoin", "pooled", "labelled", "kept"} <= reasons
    assert not edges.where("to_addr like '%:%'").count()
    # no payment is used beyond its amount
    over = edges.where("hop > 1").groupBy("origin", "tx_hash", "from_addr", "to_addr").agg(F.sum("traced").alias("t"), F.max("amount").alias("a")).where("t > a")
    assert over.count() == 0


SCRIPTS = ["1", "3", "bc1q", "bc1p"]


def test_owners_by_two_rules(spark):
    draw = random.Random(4)
    address = lambda: f"{draw.choice(SCRIPTS)}{draw.randrange(60)}"
    rows = [
        (f"t{draw.randrange(10**6)}", START + timedelta(days=draw.randrange(9)), [address() for _ in range(draw.choice([0, 1, 1, 2, 3]))], [(address(), 1) for _ in range(draw.choice([1, 2, 2, 3, 7]))])
        for _ in range(60)
    ]
    txs = spark.createDataFrame(rows, "txid string, ts timestamp, inputs array<string>, outputs array<struct<address: string, amount: long>>")
    mixes = [(r[0],) for r in rows[::7]]
    first = {}
    for txid, ts, _, outs in sorted(rows, key=lambda r: (r[1], r[0])):
        for a, _ in outs:
            first.setdefault(a, txid)
    kind = lambda a: next(s for s in ("bc1p", "bc1q", "1", "3") if a.startswith(s))
    merges = set()
    for txid, _, ins, outs in rows:
        if (txid,) in mixes or not ins:
            continue
        merges |= {(txid, ins[0], a, "co_spend") for a in ins if a != ins[0]}
        fresh = [a for a, _ in outs if first[a] == txid and kind(a) == kind(ins[0])]
        if 2 <= len(outs) <= 6 and len(fresh) == 1 and fresh[0] != ins[0]:
            merges.add((txid, ins[0], fresh[0], "change"))
    found = owners.merges(txs, spark.createDataFrame(mixes, "txid string"))
    assert {tuple(r[c] for c in ("txid", "a", "b", "rule")) for r in found.collect()} == merges
    root = {a: a for _, _, ins, outs in rows for a in [*ins, *(o for o, _ in outs)]}

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for _, a, b, _ in merges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    sizes = Counter(map(top, root))
    owned = owners.resolve(txs, spark.createDataFrame(mixes, "txid string"))
    assert sorted((r.address, r.entity, r.n) for r in owned.collect()) == sorted((a, top(a), sizes[top(a)]) for a in root)


def test_payees_are_not_owners(spark):
    txs = spark.createDataFrame([("t", ["a", "b"], [("c", 1)]), ("m", ["x", "y"], [("c", 1)])], "txid string, inputs array<string>, outputs array<struct<address: string, amount: long>>")
    edges = graph.co_spend_edges(txs, spark.createDataFrame([("m",)], "txid string"))
    assert [(r.a, r.b) for r in edges.collect()] == [("a", "b")]
