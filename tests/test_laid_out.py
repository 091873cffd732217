"""What isn't asked for isn't laid out, and long histories give what short ones do."""

import hashlib
import random

import pytest

from flowlens.operators import chain_log, flow, graph
from flowlens.session import scratch_count

MOVES = "tx_hash string, block_time timestamp, from_addr string, to_addr string, asset string, amount long"


def drawn(spark, seed, fees=False):
    draw, rows = random.Random(seed), []
    for k in range(400):
        a, b = draw.sample(range(14), 2)
        rows.append((f"t{k // 2}", f"2026-01-{1 + draw.randrange(25):02d} 00:00:00", f"w{a}", f"w{b}", draw.choice(["USDT", "COIN"]) if not fees else "BTC", draw.randint(50, 3000)))
    if fees:
        rows += [(t, at, a, f"fee:{t}", asset, 7) for t, at, a, _, asset, _ in rows[::3]]
    return spark.createDataFrame([(*r,) for r in rows], MOVES.replace("timestamp", "string")).selectExpr("tx_hash", "cast(block_time as timestamp_ntz) block_time", "from_addr", "to_addr", "asset", "amount").distinct()


@pytest.mark.parametrize("many", [False, True])
def test_long_histories_give_the_same(spark, many):
    moves = drawn(spark, 5, many)
    labels = spark.createDataFrame([("w1", "X"), ("w2", "Y")], "address string, entity string")
    origins = moves.select(moves.from_addr.alias("origin")).distinct()
    own = moves if many else None
    first, second = (flow.trace_across(moves, origins, labels, flow.Rules(whole=w), own_moves=own) for w in (20_000, 0))
    for a, b in zip(first[:3], second[:3]):
        assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_only_payments_of_wallets_asked_for_are_read(spark, monkeypatch):
    rows = [("t0", "a", "b", 5000), ("t1", "b", "c", 4000)] + [(f"u{k}", f"x{k}", "X", 500) for k in range(50)]
    moves = spark.createDataFrame([(t, a, b, v) for t, a, b, v in rows], "tx_hash string, from_addr string, to_addr string, amount long").selectExpr("tx_hash", "timestamp_ntz'2026-01-01 00:00:00' block_time", "from_addr", "to_addr", "'USDT' asset", "amount")
    seen, busy = [], flow._busy
    monkeypatch.setattr(flow, "_busy", lambda near, *more: seen.append({r.tx_hash for r in near.collect()}) or busy(near, *more))
    flow.trace(moves, moves.selectExpr("from_addr origin").distinct(), spark.createDataFrame([("X", "X")], "address string, entity string"))
    assert seen[0] == {"t1"}


def test_a_log_of_heads_is_chained_in_one_where_levels_end(spark):
    rows = spark.range(23).selectExpr("'a' log", "id n", "cast(id as string) payload")
    log = chain_log.append(None, rows, ["n"], step=2)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ends = {(r.seq - 1) // 2: r.digest for r in log.orderBy("seq").collect()}
    head = sha("a|0")
    for k in sorted(ends):
        head = sha(head + ends[k])
    found = chain_log.heads(log, step=2, most=2).collect()
    assert [(r.rows, r.levels, r["head"]) for r in found] == [(23, 2, head)]
    assert chain_log.heads(log, step=2).first().levels == 5


def test_small_components_are_found_at_once(spark):
    stars = spark.range(60).selectExpr("id div 6 * 100 a", "id div 6 * 100 + id % 6 b")
    begun = scratch_count()
    found = {(r.node, r.root) for r in graph.components(stars).collect()}
    assert found == {(k * 100 + j, k * 100) for k in range(10) for j in range(6)}
    assert scratch_count() - begun <= 3


def test_components_of_drawn_graphs(spark):
    draw = random.Random(3)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)]
    pairs = [p for p in pairs if p[0] != p[1]] + pairs[:9]
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(60):
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    found = [(r.node, r.root) for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()]
    assert sorted(found) == sorted(root.items())
