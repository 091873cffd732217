"""Queries that scan, cross bridges, and find wallets of services."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.functions import text as words
from flowlens.operators import discovery, flow, graph, labels
from flowlens.plans import binding as b
from flowlens.plans import q_flow, q_graph, q_labels
from flowlens.session import cut
from flowlens.sources import readers

GRID = [0.1 * k for k in range(10)]


def transfer_scan(spark, sf_dir):
    return readers.scan(b.transfers(spark, sf_dir).drop("amount_usd", "fee_payer"), "W7", since=F.lit("1995-01-01").cast("timestamp_ntz"), asset="USDT", limit=60)


def wallet_flows(spark, sf_dir):
    """Per wallet and direction: payments, money, counterparties, first and last, the five largest."""
    t = b.transfers(spark, sf_dir)
    both = t.select(F.col("from_addr").alias("wallet"), F.lit("out").alias("direction"), F.col("to_addr").alias("far"), "amount", "block_time").unionByName(
        t.select(F.col("to_addr").alias("wallet"), F.lit("in").alias("direction"), F.col("from_addr").alias("far"), "amount", "block_time")
    )
    per = both.groupBy("wallet", "direction", "far").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("v"), F.min("block_time").alias("f"), F.max("block_time").alias("l"))
    per = cut(per)
    rank = F.row_number().over(W.partitionBy("wallet", "direction").orderBy(F.col("v").desc(), "far"))
    best = per.withColumn("i", rank).where("i <= 5").groupBy("wallet", "direction").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "far"))), lambda x: x.far), ",").alias("top"))
    sums = per.groupBy("wallet", "direction").agg(
        F.sum("n").alias("n_tx"), F.sum("v").alias("amount"), F.count(F.lit(1)).alias("n_far"), F.min("f").alias("first_ts"), F.max("l").alias("last_ts")
    )
    return sums.join(best, ["wallet", "direction"])


def bridge_crossings(spark, sf_dir):
    """Orders as bridge deposits, matched with payouts; some don't match, some pay nothing."""
    o = b.table(spark, sf_dir, "orders")
    price = b.cents(F.col("o_totalprice"))
    deposits = o.select(F.lit("a").alias("chain"), F.concat(F.lit("D"), "o_orderkey").alias("tx_hash"), price.alias("amount"), F.expr("cast(round(o_totalprice * 100) as bigint) div 3").alias("traced"))
    matches = o.where("o_orderkey % 5 <> 0").select(F.lit("a").alias("chain"), F.concat(F.lit("D"), "o_orderkey").alias("tx_hash"), F.lit("b").alias("to_chain"), F.concat(F.lit("P"), "o_orderkey").alias("payout_tx"), F.concat(F.lit("W"), "o_custkey").alias("recipient"))
    paid = o.where("o_orderkey % 7 <> 0").select(F.lit("b").alias("chain"), F.concat(F.lit("P"), "o_orderkey").alias("tx_hash"), F.concat(F.lit("W"), "o_custkey").alias("to_addr"), F.expr("cast(round(o_totalprice * 100) as bigint) - o_orderkey % 50").alias("amount"))
    coins = paid.withColumn("asset", F.lit("USDC")).unionByName(paid.where("amount % 2 = 0").withColumn("asset", F.lit("COIN")).withColumn("amount", F.lit(1).cast("long")))
    return discovery.crossings(deposits, matches, coins)


def cluster_labels(spark, sf_dir):
    """Labels that pass to addresses which signed together; those of large parts have owners."""
    signed = q_graph.weekly(spark, sf_dir).select(F.element_at("inputs", 1).alias("a"), F.explode("inputs").alias("b")).where("a <> b")
    signed = cut(signed)
    owners = b.table(spark, sf_dir, "part").where("p_size > 37").select(F.concat(F.lit("A"), "p_partkey").alias("part"), F.col("p_brand").alias("entity"), F.lit(0.95).alias("weight"))
    seen = signed.select(F.col("a").alias("address")).unionByName(signed.select(F.col("b").alias("address"))).distinct()
    return discovery.inherit_labels(signed, cut(seen.join(owners, F.substring_index("address", "@", 1) == F.col("part")).drop("part")))


def _sweeps(spark, sf_dir):
    e = b.wallet_events(spark, sf_dir)
    owner = F.when(F.col("far").isin("C0", "C1", "C2", "C3", "C4", "C5"), "Alpha").when(F.col("far").isin("C6", "C7"), "Beta")
    return discovery.sweeps(flow.fifo_pairs(e), e.where("not is_in").select(F.col("event_id").alias("out_id"), owner.alias("entity")), share=0.3, within_s=86400 * 40)


def sweep_rule(spark, sf_dir):
    return _sweeps(spark, sf_dir)


def decide(spark, sf_dir):
    number = F.substring("wallet", 2, 20).cast("long")
    swept = _sweeps(spark, sf_dir)
    users = swept.select("wallet", number.alias("k"))
    gas = users.where("k % 3 <> 0").select("wallet", F.when(F.col("k") % 3 == 1, "Alpha").otherwise("Beta").alias("entity"))
    known = users.where("k % 10 = 0").select(F.col("wallet").alias("address"), F.lit("Alpha").alias("entity"))
    return discovery.decide(swept, gas, known)


def discover_funnel(spark, sf_dir):
    seeds = labels.seeds(b.label_sources(spark, sf_dir)).select("address", F.lit("Alpha").alias("entity")).distinct()
    return discovery.funnel(seeds, b.transfers(spark, sf_dir), cut(_sweeps(spark, sf_dir)), decide(spark, sf_dir))


def leads(spark, sf_dir):
    holds = q_flow.traced(spark, sf_dir)[1].where("reason <> 'labelled'").groupBy("origin", "wallet").agg(F.sum("received").alias("received"))
    scored = holds.select("wallet").distinct().withColumn("p", F.round((F.substring("wallet", 2, 20).cast("long") % 100) / 100, 2))
    return discovery.leads(scored, holds, share=0.02, least_p=0.3)


def risk_threshold(spark, sf_dir):
    return discovery.risk_controlled_threshold(b.scored(spark, sf_dir), 0.3, GRID)


def case_freezes(spark, sf_dir):
    """Frozen wallets that traces reach, each at its nearest place."""
    edges = q_flow.traced(spark, sf_dir)[0]
    frozen = b.labels(spark, sf_dir).where("category in ('sanctioned', 'mixer')").select("address", "entity")
    met = edges.join(frozen, edges.to_addr == frozen.address)
    return met.groupBy("origin", "address").agg(F.min("hop").cast("long").alias("hop"), F.sum("traced").alias("traced"), F.min("block_time").alias("first_time"))


def label_coverage(spark, sf_dir):
    """How many labels each provider has by chain, and how many of them a trace could name."""
    rows = b.label_sources(spark, sf_dir)
    per = rows.groupBy("source").pivot("chain", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]).agg(F.count(F.lit(1)))
    named = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("category").isin("exchange", "swap") & (F.col("tier") != "derived")).alias("can_name"))
    return per.na.fill(0).withColumnRenamed("MIDDLE EAST", "MIDDLE_EAST").join(named, "source")


def verdict_summary(spark, sf_dir):
    """Tag checks by verdict, those that didn't occur too."""
    wide = q_labels.tag_check(spark, sf_dir).groupBy().pivot("verdict", ["agrees", "differs", "unlabelled", "no_payments"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


def reach(spark, sf_dir):
    """How many wallets a wallet reaches in one step and in two, itself counted, and how line-like that is."""
    e = graph.undirected(q_flow.moves(spark, sf_dir).select(F.col("from_addr").alias("src"), F.col("to_addr").alias("dst")).distinct())
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    some = cut(both.where("cast(substring(a, 2) as bigint) % 100 = 0"))  # the stated query set, against all wallets
    one = some.groupBy("a").agg((F.count(F.lit(1)) + 1).alias("reach_1"))
    two = some.alias("x").join(both.alias("y"), F.expr("x.b = y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b")).unionByName(some.select("a", "b")).where("a <> b").groupBy("a").agg((F.count_distinct("b") + 1).alias("reach_2"))
    return one.join(two, "a").select(F.col("a").alias("entity"), "reach_1", "reach_2", F.round(F.col("reach_2") / F.col("reach_1"), 6).alias("linearity"))


def short_ids(spark, sf_dir):
    """Identifiers, qualified by chain and shortened, safe for spreadsheets."""
    c = b.table(spark, sf_dir, "customer")
    odd = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("="), "c_name")).otherwise(F.col("c_name"))
    return c.select("c_custkey", words.qualify(F.col("c_mktsegment"), odd, "MACHINERY").alias("qualified"), words.short(F.col("c_name")).alias("short"), words.cell(odd).alias("cell"), words.case_id(F.col("c_name")).alias("case_id"))


QUERIES = {
    f.__name__: f
    for f in (
        transfer_scan, wallet_flows, bridge_crossings, cluster_labels, sweep_rule, decide, discover_funnel, leads, risk_threshold, case_freezes, label_coverage,
        verdict_summary, reach, short_ids,
    )
}

_FIFO = """i as (select wallet, event_id as in_id, ts as in_ts, sum(amount) over w - amount as a, sum(amount) over w as b from wallet_events where is_in and amount > 0
        window w as (partition by wallet order by ts, event_id rows unbounded preceding)),
    o as (select wallet, event_id as out_id, ts as out_ts, far, sum(amount) over w - amount as a, sum(amount) over w as b from wallet_events where not is_in and amount > 0
        window w as (partition by wallet order by ts, event_id rows unbounded preceding)),
    fp as (select i.wallet, out_id, case when far in ('C0', 'C1', 'C2', 'C3', 'C4', 'C5') then 'Alpha' when far in ('C6', 'C7') then 'Beta' end as entity,
        (least(i.b, o.b) - greatest(i.a, o.a))::bigint as amount, floor((epoch_us(out_ts) - epoch_us(in_ts)) / 1000000)::bigint as wait_s from i join o on i.wallet = o.wallet and i.a < o.b and o.a < i.b),
    pe as (select wallet, entity, coalesce(sum(amount) filter (entity is not null and wait_s <= 86400 * 40), 0)::bigint as v, sum(amount)::bigint as al,
        median(wait_s) filter (entity is not null and wait_s <= 86400 * 40) as med from fp group by all),
    be as (select *, row_number() over (partition by wallet order by v desc, coalesce(entity, '') desc) as n, sum(al) over (partition by wallet) as total from pe),
    sw as (select wallet, case when v > 0 then entity end as entity, v as forwarded, total::bigint as total, case when v > 0 then med::double end as median_s, v >= 0.3 * total and v > 0 as swept from be where n = 1)"""
_DECIDE = """q as (select *, substr(wallet, 2)::bigint as k from sw where swept),
    dc as (select wallet, entity, case when k % 10 = 0 then 'known' when k % 3 <> 0 and case when k % 3 = 1 then 'Alpha' else 'Beta' end <> entity then 'conflict' else 'derived' end as status, k from q),
    de as (select wallet, status, entity, case when status = 'derived' then round(0.6::double * case when k % 3 = 0 then 0.85 else 1.0 end, 4) end as confidence from dc)"""

ORACLES = {
    "transfer_scan": b.sql("transfers", """with r as (select * exclude (amount_usd, fee_payer) from transfers where (from_addr = 'W7' or to_addr = 'W7') and block_time >= '1995-01-01' and asset = 'USDT'
            order by block_time, tx_hash, from_addr, to_addr, asset, amount limit 61), n as (select count(*) as n from r)
        select r.*, n <= 60 as complete from r, n order by block_time, tx_hash, from_addr, to_addr, asset, amount limit 60"""),
    "wallet_flows": b.sql("transfers", """with x as (select from_addr as wallet, 'out' as direction, to_addr as far, amount, block_time from transfers union all select to_addr, 'in', from_addr, amount, block_time from transfers),
        p as (select wallet, direction, far, count(*) as n, sum(amount)::bigint as v, min(block_time) as f, max(block_time) as l from x group by all),
        r as (select *, row_number() over (partition by wallet, direction order by v desc, far) as k from p)
        select wallet, direction, sum(n)::bigint as n_tx, sum(v)::bigint as amount, count(*) as n_far, min(f) as first_ts, max(l) as last_ts, string_agg(far, ',' order by k) filter (k <= 5) as top from r group by all"""),
    "bridge_crossings": """with d as (select o_orderkey as k, 'D' || o_orderkey as tx_hash, round(o_totalprice * 100)::bigint as amount, round(o_totalprice * 100)::bigint // 3 as traced, 'W' || o_custkey as w from orders),
        m as (select *, k % 5 <> 0 as hit, k % 5 <> 0 and k % 7 <> 0 as got, amount - k % 50 as paid from d),
        c as (select *, case when got then least(traced, ((paid::hugeint * traced) // amount)::bigint) end as o from m)
        select tx_hash, case when got then 'followed' else 'unresolved' end as status, case when not hit then 'no_match' when not got then 'no_payout' end as reason,
               case when hit then 'b' end as to_chain, case when hit then w end as recipient, o as out, traced - o as fee from c""",
    "cluster_labels": b.sql("utxo", """with wk as (select *, '@' || strftime(date_trunc('week', ts), '%Y%m%d') as k from utxo), g as (select inputs[1] || k as a, unnest(inputs) || k as b from wk), p as materialized (select distinct a, b from g where a <> b),
        y as materialized (select a, b from p union all select b, a from p), r(node, root) as (select a, a from y union select y.b, r.root from r join y on y.a = r.node),
        c as (select node, min(root) as root from r group by node), l as materialized (select distinct y.a as address, p_brand as entity from y join part on split_part(y.a, '@', 1) = 'A' || p_partkey where p_size > 37),
        o as (select root, max(entity) as entity from c join l on node = address group by root having count(distinct entity) = 1)
        select node as address, entity, round(0.95 * 0.9, 4)::double as confidence from c join o using (root) where node not in (select address from l) and node in (select a from y where b in (select address from l))"""),
    "sweep_rule": b.sql("wallet_events", f"with {_FIFO} select * from sw"),
    "decide": b.sql("wallet_events", f"with {_FIFO}, {_DECIDE} select * from de"),
    "discover_funnel": b.sql("wallet_events label_sources transfers", f"""with {_FIFO}, {_DECIDE}, s as (select distinct address from label_sources where category in ('exchange', 'swap') and tier <> 'derived' and kind <> 'deposit')
        select 'Alpha' as entity, (select count(*) from s) as n_seeds, (select count(distinct from_addr) from transfers where to_addr in (select address from s)) as n_senders,
               (select count(*) from sw where swept and entity = 'Alpha') as n_swept, (select count(*) from de where status = 'derived' and entity = 'Alpha') as n_derived"""),
    "leads": b.sql("transfers labels", f"""{q_flow._ALL}, w as (select origin, wallet, sum(received)::bigint as received from h where reason <> 'labelled' group by all),
        ax as (select *, sum(received) over (partition by origin) as al from w), k as (select *, row_number() over (partition by origin order by received desc, wallet) as n from ax where received >= 0.02 * al)
        select origin, wallet, received, round((substr(wallet, 2)::bigint % 100) / 100, 2) as p from k where n <= 5 and round((substr(wallet, 2)::bigint % 100) / 100, 2) >= 0.3"""),
    "case_freezes": b.sql("transfers labels", f"""{q_flow._ALL} select origin, address, min(hop)::bigint as hop, sum(traced)::bigint as traced, min(block_time) as first_time from e
        join labels_rel on to_addr = address where category in ('sanctioned', 'mixer') group by all"""),
    "label_coverage": b.sql("label_sources", "select source, " + ", ".join(f"count(*) filter (chain = '{c}') as {c.replace(' ', '_')}" for c in ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])
        + ", count(*) as n, count(*) filter (category in ('exchange', 'swap') and tier <> 'derived') as can_name from label_sources group by source"),
    "verdict_summary": "select " + ", ".join(f"count(*) filter (verdict = '{v}') as {v}" for v in ["agrees", "differs", "unlabelled", "no_payments"]) + f" from ({q_labels.ORACLES['tag_check']})",
    "reach": b.sql("transfers", """with u as (select distinct least(from_addr, to_addr) as a, greatest(from_addr, to_addr) as b from transfers where from_addr <> to_addr), y as (select a, b from u union all select b, a from u),
        s as (select * from y where substr(a, 2)::bigint % 100 = 0), one as (select a, count(*) + 1 as reach_1 from s group by a),
        two as (select a, count(distinct b) + 1 as reach_2 from (select s.a, y.b from s join y on s.b = y.a union all select a, b from s) where a <> b group by a)
        select a as entity, reach_1, reach_2, round(reach_2 / reach_1, 6) as linearity from one join two using (a)"""),
    "short_ids": """with c as (select c_custkey, c_name, c_mktsegment, case when c_custkey % 4 = 0 then '=' || c_name else c_name end as odd from customer)
        select c_custkey, case when c_mktsegment = 'MACHINERY' then odd else c_mktsegment || ':' || odd end as qualified,
               case when length(c_name) <= 11 then c_name else substr(c_name, 1, 6) || '…' || right(c_name, 4) end as short, case when odd like '=%' then chr(39) || odd else odd end as cell,
               'c-' || substr(sha256(c_name), 1, 10) as case_id from c""",
}
