"""What SQL can't express, against plain Python, and cases at the edges."""

import math
import random
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from flowlens.functions import addresses, stats
from flowlens.functions import text as words
from flowlens.operators import flow, graph, metrics, ml, typologies, views

START = datetime(2026, 1, 1)


def events(seed, n=60, wallets=4):
    r = random.Random(seed)
    return [(f"w{r.randrange(wallets)}", k, START + timedelta(minutes=r.randrange(500)), r.random() < 0.5, r.randrange(0, 900)) for k in range(n)]


EVENTS = "wallet string, event_id long, ts timestamp, is_in boolean, amount long"


def queue(rows):
    """take of each outflow: arrivals fill a pool that outflows drain."""
    pool, out = {}, {}
    for w, k, ts, is_in, amount in sorted(rows, key=lambda r: (r[2], not r[3], r[1])):
        have = pool.get(w, 0)
        out[k] = 0 if is_in else min(have, amount)
        pool[w] = have + amount if is_in else have - out[k]
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("span", ["hour", "year"])
def test_allocation_is_a_pool(spark, seed, span):
    rows = events(seed)
    df = spark.createDataFrame(rows, EVENTS).withColumn("span", F.date_trunc(span, "ts"))
    got = flow.allocate(df, ["wallet"], [F.col("ts"), F.col("is_in").desc(), F.col("event_id")])
    assert {r.event_id: r["take"] for r in got.collect()} == queue(rows)


def stack(rows):
    held, out = {}, []
    for w, k, ts, is_in, amount in sorted(rows, key=lambda r: (r[2], not r[3], r[1])):
        if is_in:
            held.setdefault(w, []).append([k, ts, amount])
            continue
        mine = held.get(w, [])
        while amount > 0 and mine:
            used = min(amount, mine[-1][2])
            if used:
                out.append((w, k, mine[-1][0], used, int((ts - mine[-1][1]).total_seconds())))
            amount, mine[-1][2] = amount - used, mine[-1][2] - used
            if not mine[-1][2]:
                mine.pop()
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_lifo_pairs_are_a_stack(spark, seed):
    rows = events(seed)
    assert sorted(map(tuple, flow.lifo_pairs(spark.createDataFrame(rows, EVENTS)).collect())) == stack(rows)


def moves(rows):
    return [(f"t{k}", START + timedelta(hours=h), a, b, "USDT", v) for k, (h, a, b, v) in enumerate(rows)]


MOVES = "tx_hash string, block_time timestamp, from_addr string, to_addr string, asset string, amount long"
LABELS = "address string, entity string, category string, tier string, kind string"


def test_trace_follows_money_out_of_wallets(spark):
    rows = moves([(0, "O", "A", 1000), (1, "A", "X", 600), (2, "A", "B", 900), (-1, "A", "Y", 50_000), (3, "B", "X", 400), (9, "O", "B", 500), (10, "B", "B", 700), (11, "B", "C", 100)])
    labels = spark.createDataFrame([("X", "Ex", "exchange", "published_por", "hot")], LABELS)
    edges, holds, seen = flow.trace(spark.createDataFrame(rows, MOVES), spark.createDataFrame([("O",)], "origin string"), labels)
    drawn = {(r.hop, r.from_addr, r.to_addr): r.traced for r in edges.collect()}
    # what A paid before the money came isn't this money; B is reached twice and pays its own share each time
    assert drawn == {(1, "O", "A"): 1000, (1, "O", "B"): 500, (2, "A", "X"): 600, (2, "A", "B"): 400, (2, "B", "C"): 100, (3, "B", "X"): 400}
    kept = {(r.hop, r.wallet, r.reason): r.held for r in holds.collect()}
    assert kept[2, "X", "labelled"] == 600 and kept[3, "X", "labelled"] == 400 and kept[1, "B", "kept"] == 400
    named = {r.entity: r for r in flow.candidates(edges, labels).collect()}["Ex"]
    assert named.received == 1000 and named.hops == 2 and math.isclose(named.confidence, round(0.95 * (600 * 0.85 + 400 * 0.85**2) / 1000, 4))
    assert flow.outcome(edges, labels).first().outcome == "ATTRIBUTED"


def test_hidden_labels_let_the_trace_go_on(spark):
    rows = spark.createDataFrame(moves([(0, "O", "X", 1000), (1, "X", "Z", 1000)]), MOVES)
    labels = spark.createDataFrame([("X", "Ex", "exchange", "published_por", "hot")], LABELS)
    origin = spark.createDataFrame([("O",)], "origin string")
    hidden = spark.createDataFrame([("O", "Ex")], "origin string, entity string")
    assert flow.trace(rows, origin, labels)[0].count() == 1 and flow.trace(rows, origin, labels, hidden=hidden)[0].count() == 2


def test_hubs_dust_and_small_shares_stop(spark):
    rows = [(0, "O", "H", 5000), (0, "O", "S", 20), (0, "O", "T", 40_000), (0, "O", "D", 5)] + [(1, "H", f"h{k}", 200) for k in range(6)] + [(1, "S", "q", 20), (1, "T", "u", 40_000)]
    out = flow.trace(spark.createDataFrame(moves(rows), MOVES), spark.createDataFrame([("O",)], "origin string"), spark.createDataFrame([], LABELS), flow.Rules(hub_degree=5, dust=10))
    assert {(r.wallet, r.reason) for r in out[1].where("hop = 1").collect()} == {("H", "hub"), ("S", "small"), ("T", "kept")}


def test_trace_of_funders_goes_back_in_time(spark):
    rows = moves([(10, "S", "O", 600), (9, "P", "S", 500), (8, "Q", "S", 300), (11, "R", "S", 900), (12, "O", "Z", 100)])
    edges, holds, _ = flow.trace(spark.createDataFrame(rows, MOVES), spark.createDataFrame([("O",)], "origin string"), spark.createDataFrame([], LABELS), flow.Rules(hops=2), inbound=True)
    # what came to S after it paid O isn't what it paid with; the latest money before goes first
    assert {(r.hop, r.from_addr, r.to_addr): r.traced for r in edges.collect()} == {(1, "S", "O"): 600, (2, "P", "S"): 500, (2, "Q", "S"): 100}
    assert {(r.hop, r.wallet, r.reason): r.held for r in holds.collect()} == {(1, "S", "kept"): 0, (2, "P", "depth_limit"): 500, (2, "Q", "depth_limit"): 100}


def test_a_limit_of_payments_and_of_wallets_is_told(spark):
    rows = [(0, "O", "A", 1000), (1, "A", "b", 100), (2, "A", "c", 200), (3, "A", "d", 700)]
    run = lambda rows, **rules: flow.trace(spark.createDataFrame(moves(rows), MOVES), spark.createDataFrame([("O",)], "origin string"), spark.createDataFrame([], LABELS), flow.Rules(**rules))
    limited = run(rows, fetch_limit=2)[1].where("hop = 1").collect()
    assert [(r.wallet, r.reason, r.held) for r in limited] == [("A", "truncated", 700)]
    assert [(r.wallet, r.reason, r.held) for r in run(rows)[1].where("hop = 1").collect()] == [("A", "kept", 0)]
    wide = [(0, "O", w, v) for w, v in (("A", 500), ("B", 400), ("C", 300))] + [(1, w, "z", 100) for w in "ABC"]
    assert {(r.wallet, r.reason) for r in run(wide, max_nodes=2)[1].where("hop = 1").collect()} == {("A", "kept"), ("B", "kept"), ("C", "budget")}


def test_core_numbers(spark):
    r = random.Random(2)
    pairs = {tuple(sorted(r.sample(range(30), 2))) for _ in range(90)}
    got = {row.entity: row.core for row in graph.core_numbers(spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")).collect()}
    near = {}
    for a, b in pairs:
        near.setdefault(str(a), set()).add(str(b))
        near.setdefault(str(b), set()).add(str(a))
    core, left, k = {}, dict(near), 0
    while left:
        low = [v for v in left if sum(n in left for n in left[v]) <= k]
        if not low:
            k += 1
        for v in low:
            core[v] = k
            del left[v]
    assert got == core


def test_components_of_strings(spark):
    edges = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}") for k in range(60)] + [("z1", "z2"), ("z9", "z9")], "a string, b string")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**{f"n{k:03d}": "n000" for k in range(61)}, "z1": "z1", "z2": "z1"}


def test_exact_intervals_and_tests():
    for hits, n in ((0, 10), (3, 10), (10, 10), (1, 1000)):
        low, high = stats.clopper_pearson(hits, n)
        tail = lambda p, ks: sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in ks)
        assert hits == 0 and low == 0 or math.isclose(tail(low, range(hits, n + 1)), 0.025, rel_tol=1e-6)
        assert hits == n and high == 1 or math.isclose(tail(high, range(hits + 1)), 0.025, rel_tol=1e-6)
    assert math.isclose(stats.fisher_exact(8, 2, 1, 5), float(Fraction(0)) + 0.034965034965, rel_tol=1e-6)
    assert stats.isotonic([3, 1, 2], [1, 1, 2]) == [2, 2, 2]


def test_em_finds_the_share(spark):
    r = random.Random(7)
    rows = []
    for k in range(4000):
        y = r.random() < 0.2
        x = r.gauss(1.5 if y else 0, 1)
        rows.append((k, 1 / (1 + math.exp(-(1.5 * x - 1.125)))))  # the posterior under equal shares
    assert abs(metrics.em_prior(spark.createDataFrame(rows, "idx long, score double"), 0.5) - 0.2) < 0.04


@pytest.mark.parametrize("address,form", [
    ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "bitcoin"), ("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", None), ("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", "bitcoin"),
    ("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5", None), ("TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6t", "tron"), ("0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", "evm"),
    ("0x5aAeb6053F3E94C9b9A09f33669435E7Ef1Beaed", None), ("0x5aaeb6053f3e94c9b9a09f33669435e7ef1beaed", "evm"), ("", None), (None, None), ("hello", None),
])
def test_address_forms(spark, address, form):
    assert spark.createDataFrame([(address,)], "a string").select(addresses.detect_form(F.col("a")).alias("f")).first().f == form


def test_words(spark):
    row = spark.range(1).select(
        words.percent(F.lit(0.004)).alias("a"), words.percent(F.lit(0.996)).alias("b"), words.percent(F.lit(0.125)).alias("c"), words.duration(F.lit(7200)).alias("d"), words.duration(F.lit(59)).alias("e"),
        words.indian_groups(F.lit(1234567)).alias("f"), words.indian_groups(F.lit(999)).alias("g"), words.indian_groups(F.lit(123456789)).alias("h"), words.plain_decimal(F.lit("1.500")).alias("i"),
        words.plain_decimal(F.lit("100")).alias("j"), words.cell(F.lit("=1+1")).alias("k"), words.short(F.lit("abcdefghijklmnop")).alias("l"), words.duration(F.lit(0)).alias("m"),
    ).first()
    assert tuple(row) == ("under 1%", "over 99%", "12%", "2 hours", "59 seconds", "12,34,567", "999", "12,34,56,789", "1.5", "100", "'=1+1", "abcdef…mnop", "0 seconds")


def test_fan_out_counts_across_days(spark):
    rows = [("s", START + timedelta(hours=20 + h), f"t{h % 7}") for h in range(12)] + [("q", START, "t")]
    got = {r.sender: r.most for r in typologies.fan_out(spark.createDataFrame(rows, "sender string, ts timestamp, to_addr string")).collect()}
    assert got == {"s": 7, "q": 1}


def test_replay_of_freezes(spark):
    rows = [("a", START, 1, True), ("a", START + timedelta(1), 2, False), ("a", START + timedelta(2), 3, True), ("a", START + timedelta(3), 4, True), ("b", START, 5, True), ("b", START, 6, False)]
    df = spark.createDataFrame(rows, "address string, ts timestamp, seq long, added boolean")
    assert [(r.address, r.since) for r in views.replay(df).collect()] == [("a", START + timedelta(2))]
    assert [r.address for r in views.released(df).collect()] == ["b"]


def test_betweenness_over_all_pivots(spark):
    r = random.Random(3)
    pairs = {tuple(r.sample("abcdefghij", 2)) for _ in range(22)}
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    nodes = sorted({v for p in pairs for v in p})

    def paths(s, t):
        level, seen = [[s]], {s}
        while level:
            found = [p for p in level if p[-1] == t]
            if found:
                return found
            level = [[*p, n] for p in level for n in out.get(p[-1], ()) if n not in seen]
            seen |= {p[-1] for p in level}
        return []

    expected = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for t in nodes:
            if s != t and (found := paths(s, t)):
                for p in found:
                    for v in p[1:-1]:
                        expected[v] += 1 / len(found)
    got = graph.betweenness(spark.createDataFrame(list(pairs), "src string, dst string"), spark.createDataFrame([(v,) for v in nodes], "entity string"))
    assert {row.entity: row.betweenness for row in got.collect()} == pytest.approx(expected, abs=1e-3)


def test_trees_rank_and_give_reasons(spark):
    from flowlens.operators import ml

    r = random.Random(5)
    rows = [(k, x := r.random(), r.random(), int(x > 0.6)) for k in range(300)]
    df = spark.createDataFrame(rows, "k long, signal double, noise double, y int")
    model = ml.fit_trees(df, ["signal", "noise"], trees=5)
    scored = {row.k: row.p for row in ml.score_trees(model, df, ["signal", "noise"]).collect()}
    assert sum((scored[k] > 0.5) == bool(y) for k, _, _, y in rows) > 285
    assert ml.importance(model, ["signal", "noise"])[0][0] == "signal"
    first = [row for row in ml.reasons(model, df.where("signal > 0.9"), ["signal", "noise"], "k").collect() if row["rank"] == 1]
    assert len(first) == sum(x > 0.9 for _, x, _, _ in rows)


def test_novelty_finds_the_odd_ones(spark):
    from flowlens.operators import ml

    r = random.Random(6)
    rows = [(k, [r.gauss(0, 1) + (9 if k < 3 else 0) for _ in range(4)]) for k in range(200)]
    got = {row.k: row.novelty for row in ml.novelty(spark.createDataFrame(rows, "k long, v array<double>"), "v").collect()}
    assert min(got[k] for k in range(3)) > 0.95 and sum(v > 0.9 for v in got.values()) < 20


def test_confusion_layout_and_chase(spark):
    from flowlens.operators import evaluation

    rows = spark.createDataFrame([(1, True), (1, False), (0, True), (0, False), (0, False)], "y int, hit boolean")
    assert tuple(evaluation.confusion(rows, "hit").first()) == (1, 1, 1, 2)
    steps = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(13)] + [("x", "y"), ("y", "x")], "wallet string, next string")
    got = {row.wallet: (row.end, row.length) for row in evaluation.chase(steps, 5).where("wallet like 'n%'").collect()}
    assert got == {f"n{k}": ("n13", 13 - k) for k in range(13)}


def test_scratch_tables_can_be_dropped(spark, tmp_path):
    from flowlens import session

    kept = session.written(spark.range(3), "drop-me")
    assert kept.count() == 3
    path = session._SCRATCH[-1]
    assert session.drop_scratch(spark) > 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()


def dense_regions(points, width, min_rows, min_cluster):
    """{id: (the first cell of its region or -1, rows there)}, by a walk over touching cells."""
    spots = {k: tuple(math.floor(v / width) for v in at) for k, at in points.items() if None not in at and not any(map(math.isnan, at))}
    n = {}
    for c in spots.values():
        n[c] = n.get(c, 0) + 1
    touch = lambda c: [(c[0] + x, c[1] + y) for x in (-1, 0, 1) for y in (-1, 0, 1)]
    region = {}
    for c in sorted(c for c in n if n[c] >= min_rows):
        todo = [] if c in region else [c]
        while todo:
            at = todo.pop()
            region[at] = c
            todo += [o for o in touch(at) if n.get(o, 0) >= min_rows and o not in region]
    for c in [c for c in n if n[c] < min_rows]:
        near = [(n[o], o) for o in touch(c) if n.get(o, 0) >= min_rows]
        region[c] = region[max(near)[1]] if near else None
    size = {}
    for c, root in region.items():
        size[root] = size.get(root, 0) + n[c]
    out = {}
    for k in points:
        root = region.get(spots.get(k))
        big = root is not None and size[root] >= min_cluster
        out[k] = (",".join(map(str, root)), size[root]) if big else ("-1", 0)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_density_clusters_are_touching_cells(spark, seed):
    r = random.Random(seed)
    points = {k: (r.gauss(3 * (k % 3), 0.4), r.gauss(-2 * (k % 2), 0.4)) for k in range(300)}
    points |= {300: (None, 1.0), 301: (math.nan, 1.0), 302: (90.0, 90.0)} | {k: (40.1, 40.1) for k in range(303, 333)}
    df = spark.createDataFrame([(k, *at) for k, at in points.items()], "id long, x double, y double")
    found = {row.id: (row.cluster, row["size"]) for row in ml.density_clusters(df, "id", ["x", "y"], 0.25, 4, 20).collect()}
    expected = dense_regions(points, 0.25, 4, 20)
    assert found == expected
    assert found[302] == ("-1", 0) and found[303][1] == 30 and len(set(found.values())) > 2


def test_density_clusters_of_nothing(spark):
    assert ml.density_clusters(spark.createDataFrame([], "id long, x double"), "id", ["x"]).count() == 0
