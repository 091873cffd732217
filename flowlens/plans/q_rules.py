"""Queries of small rules, and of tables that judge rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import rules
from flowlens.operators import evaluation
from flowlens.plans import binding as b
from flowlens.plans import q_flow


def payment_rules(spark, sf_dir):
    t = b.transfers(spark, sf_dir)
    asset = F.when(F.col("amount") % 9 == 0, F.concat("asset", F.lit("@c"))).otherwise(F.col("asset"))
    return t.groupBy(asset.alias("kind"), rules.is_dust(asset, F.col("amount") % 300).alias("dust"), rules.pays(asset).alias("pays"), rules.direction(F.col("to_addr"), F.col("from_addr")).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


def label_rules(spark, sf_dir):
    s = b.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    name = F.concat(F.col("s_name"), b._pick(["", " #12", " Hot Wallet 3", " (old)", " token"], k % 5))
    category = b._pick(["custodial", "dex", "otc", "mixer"], k % 4)
    return s.select(
        "s_suppkey", rules.owner_of(name).alias("owner"), rules.map_category(category, name, ["Supplier#000000007"]).alias("category"),
        rules.source_family(b._pick(["registry+x", "y+crowd", "z", "model"], k % 4)).alias("family"), rules.sink_reason(b._pick(["pool:1", "cj:2", "q:3"], k % 3)).alias("sink"),
        rules.regime_threat(b._pick(["Cyber attacks", "TERROR list", "anti-fraud", "other"], k % 4)).alias("threat"),
        rules.iso_date(b._pick(["3/4/2021", "12/31/2020", "2020-01-01"], k % 3)).alias("date"), rules.is_plain(b._pick(["abc", "x:y", "0x000"], k % 3)).alias("plain"),
    )


def number_rules(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey", rules.points(k % 60, F.lit(30), (k % 101) / 100, k % 5).alias("points"), F.round(rules.strength(F.pow(F.lit(10.0), -(k % 15)), (k % 50) / 10.0), 6).alias("strength"),
        rules.hops_text(k % 4).alias("hops"), rules.elapsed_text(k * 61).alias("elapsed"), rules.route_of(F.col("o_orderpriority"), "5-LOW", ["1-URGENT", "2-HIGH"]).alias("route"),
        rules.routable(k % 3, (k % 10) / 10, F.when(k % 7 != 0, k), k % 2, 0.6).alias("routable"),
    )


def amount_words(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    cents = b.cents(F.col("o_totalprice")) % 300000
    return o.select("o_orderkey", rules.amount_text(cents, F.lit("USDT")).alias("amount"), rules.frozen_text(F.lit("issuer"), F.col("o_orderdate")).alias("frozen"), rules.digest(F.col("o_orderkey"), cents).alias("digest"))


def chain_coverage(spark, sf_dir):
    """Which part of three chains each entity has labels on."""
    per = b.label_sources(spark, sf_dir).groupBy("entity").agg(F.array_sort(F.collect_set("chain")).alias("chains"))
    return per.select("entity", rules.chain_status(F.array(*map(F.lit, ["ASIA", "EUROPE"])), F.col("chains")).alias("status"))


def forward_rule(spark, sf_dir):
    rows = b.scored(spark, sf_dir).withColumn("hit", F.col("score") >= 0.5)
    return evaluation.confusion(rows, "hit")


def method_by_hops(spark, sf_dir):
    claims = b.scored(spark, sf_dir).select((F.col("idx") % 4).alias("hops"), (F.col("score") >= 0.3).alias("named"), (F.col("y") == 1).alias("right"))
    return evaluation.by_depth(claims)


def fired_rules(spark, sf_dir):
    codes = F.array_compact(F.array(F.when(F.col("score") > 0.5, "high"), F.when(F.col("amount") > 1000, "long"), F.when(F.col("toxic") == 1, "toxic")))
    rows = b.scored(spark, sf_dir).select("idx", F.when(F.col("y") == 1, "good").otherwise("bad").alias("arm"), codes.alias("codes"))
    return evaluation.fired(rows, ("good", "bad"))


def nearest_rank(spark, sf_dir):
    return evaluation.nearest_rank(b.table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", [0.5, 0.95])


def graph_layout(spark, sf_dir):
    edges = q_flow.traced(spark, sf_dir)[0]
    wallets = edges.groupBy("origin", F.col("to_addr").alias("wallet")).agg(F.min("hop").cast("long").alias("hop"), F.sum("traced").alias("amount"))
    return evaluation.layout(wallets.withColumn("must", F.col("wallet") == "W3"))


def peel_chains(spark, sf_dir):
    """Following every wallet's largest payment, wallet by wallet, towards larger numbers only."""
    t = b.transfers(spark, sf_dir).where("cast(substring(to_addr, 2) as bigint) > cast(substring(from_addr, 2) as bigint)").groupBy("from_addr", "to_addr").agg(F.sum("amount").alias("v"))
    steps = t.groupBy(F.col("from_addr").alias("wallet")).agg(F.max_by("to_addr", F.struct("v", "to_addr")).alias("next"))
    return evaluation.chase(steps, 6)


QUERIES = {
    f.__name__: f
    for f in (payment_rules, label_rules, number_rules, amount_words, chain_coverage, forward_rule, method_by_hops, fired_rules, nearest_rank, graph_layout, peel_chains)
}

_ORDER = "must desc, amount desc, wallet"
ORACLES = {
    "payment_rules": b.sql("transfers", """with k as (select case when amount % 9 = 0 then asset || '@c' else asset end as kind, amount % 300 as a, to_addr = from_addr as self from transfers)
        select kind, a <= 0 or a < case kind when 'USDT' then 100 when 'USDC' then 100 when 'COIN' then 50 else 10 end as dust, kind not like '%@%' as pays, case when self then 'out' else 'in' end as direction,
               count(*) as n from k group by all"""),
    "label_rules": r"""with s as (select s_suppkey, s_suppkey as k, s_name || ['', ' #12', ' Hot Wallet 3', ' (old)', ' token'][s_suppkey % 5 + 1] as name from supplier)
        select s_suppkey, case k % 5 when 0 then s.name when 1 then left(name, length(name) - 4) when 2 then left(name, length(name) - 13) when 3 then left(name, length(name) - 6) else name end as owner,
               case when k % 5 = 4 then 'contract' when name = 'Supplier#000000007' then 'exchange' when k % 4 in (0, 2) then 'exchange' when k % 4 = 1 then 'swap' else 'mixer' end as category,
               ['official lists', 'reports', 'others', 'own findings'][k % 4 + 1] as family, ['pooled with others', 'joined with others', 'other'][k % 3 + 1] as sink,
               ['ransomware', 'terrorism', 'scam', null][k % 4 + 1] as threat, ['2021-03-04', '2020-12-31', '2020-01-01'][k % 3 + 1] as date, k % 3 = 0 as plain from s""",
    "number_rules": """with o as (select o_orderkey as k, o_orderpriority as p from orders)
        select k as o_orderkey, least(k % 60 + round_even(30 * ((k % 101) / 100) * [1.0::double, 0.8::double, 0.6::double][least(greatest(k % 5, 1), 3)], 0)::bigint, 100) as points,
               round(sqrt(least(greatest((k % 15) / 12, 0), 1) * least(greatest((k % 50) / 10 / 4, 0), 1)), 6) as strength,
               (k % 4) || case when k % 4 = 1 then ' hop' else ' hops' end as hops,
               case when k * 61 >= 86400 then ((k * 61) // 86400) || 'd ' || ((k * 61) % 86400 // 3600) || 'h' when k * 61 >= 3600 then ((k * 61) // 3600) || 'h ' || ((k * 61) % 3600 // 60) || 'm'
                    when k * 61 >= 60 then ((k * 61) // 60) || 'm ' || ((k * 61) % 60) || 's' else (k * 61) || 's' end as elapsed,
               case when p = '5-LOW' then 'domestic' when p in ('1-URGENT', '2-HIGH') then 'direct' else 'offshore' end as route,
               k % 3 >= 1 and (k % 10) / 10 >= 0.6::double and k % 7 <> 0 and k % 2 > 0 as routable from o""",
    "chain_coverage": b.sql("label_sources", """with p as (select entity, list(distinct chain) as c from label_sources group by entity)
        select entity, case when list_contains(c, 'ASIA') and list_contains(c, 'EUROPE') then 'all' when list_contains(c, 'ASIA') or list_contains(c, 'EUROPE') then 'some' else 'none' end as status from p"""),
    "forward_rule": b.sql("scored", """select count(*) filter (score >= 0.5 and y = 1) as tp, count(*) filter (score >= 0.5 and y <> 1) as fp, count(*) filter (score < 0.5 and y = 1) as fn,
        count(*) filter (score < 0.5 and y <> 1) as tn from scored"""),
    "method_by_hops": b.sql("scored", """with p as (select idx % 4 as hops, count(*) as n, count(*) filter (score >= 0.3) as named, count(*) filter (score >= 0.3 and y <> 1) as wrong from scored group by rollup (idx % 4))
        select *, round(wrong / nullif(named, 0), 6) as error from p"""),
    "nearest_rank": """with r as (select event_type, event_id, row_number() over (partition by event_type order by event_id) as i, count(*) over (partition by event_type) as n from events)
        select event_type, s::double as share, event_id from r, (select unnest([0.5, 0.95]) as s) where i = floor(s::double * (n - 1)) + 1""",
    "graph_layout": b.sql("transfers labels", f"""{q_flow._ALL}, w as (select origin, to_addr as wallet, min(hop)::bigint as hop, sum(traced) as amount, to_addr = 'W3' as must from e group by all),
        c as (select *, row_number() over (partition by origin, hop order by {_ORDER}) as c from w), z as (select *, row_number() over (partition by origin order by {_ORDER}) as place from c where c <= 7)
        select origin, hop, wallet, place from z where place <= 18"""),
    "peel_chains": b.sql("transfers", """with t as (select from_addr as wallet, to_addr, sum(amount) as v from transfers where substr(to_addr, 2)::bigint > substr(from_addr, 2)::bigint group by all),
        s as (select wallet, arg_max(to_addr, row(v, to_addr)) as nx from t group by wallet), r(wallet, spot, n) as (select wallet, nx, 1 from s union all select r.wallet, s.nx, n + 1 from r join s on r.spot = s.wallet)
        select wallet, arg_max(spot, n) as "end", max(n)::bigint as length from r group by wallet"""),
}
