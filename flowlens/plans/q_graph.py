"""Queries on graphs, many-party transactions, patterns and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import edges, flow, graph, owners, typologies, utxo
from flowlens.plans import binding as b
from flowlens.session import cut

def _edges(spark, sf_dir):
    return cut(edges.entity_edges(b.transfers(spark, sf_dir)))


def weekly(spark, sf_dir, form=lambda x: x):
    """Transactions of wallets that take new addresses every week, so that an address is one of a week, of that form."""
    own = lambda x: F.concat(form(x), "week")
    rows = b.utxo(spark, sf_dir).withColumn("week", F.concat(F.lit("@"), F.date_format(F.date_trunc("week", "ts"), "yyyyMMdd")))
    outputs = F.transform("outputs", lambda x: F.struct(own(x.address).alias("address"), x.amount.alias("amount")))
    return rows.withColumns({"inputs": F.transform("inputs", own), "outputs": outputs}).drop("week")


def _mixes(rows):
    return utxo.coinjoins(rows).where("is_coinjoin")


def components_week(spark, sf_dir):
    """Wallets by the addresses of a week that they spend together, for all weeks."""
    rows = weekly(spark, sf_dir).where(~utxo.is_coinjoin())
    return graph.components(graph.co_spend_edges(rows, once=False))


def scripted(spark, sf_dir):
    """The weekly addresses in the forms of four script types, each wallet's of one type."""
    kind = lambda x: F.element_at(F.array(*map(F.lit, SCRIPTS)), (F.crc32(F.substr(x, F.lit(2)).cast("binary")) % len(SCRIPTS) + 1).cast("int"))
    return weekly(spark, sf_dir, lambda x: F.concat(kind(x), x))


SCRIPTS = ["1", "3", "bc1q", "bc1p"]


def _parties(spark, sf_dir):
    """What owners are told from, without amounts; `mix`: of several owners."""
    rows = scripted(spark, sf_dir).withColumn("mix", utxo.is_coinjoin())
    return cut(rows.select("txid", "ts", "inputs", F.transform("outputs", lambda x: F.struct(x.address.alias("address"))).alias("outputs"), "mix"))


def resolve_entities(spark, sf_dir):
    """Owners of all addresses, by spending together and by change."""
    return owners.resolve(_parties(spark, sf_dir), F.col("mix"))


def owner_merges(spark, sf_dir):
    """Each merge of two addresses, told by its rule."""
    return owners.merges(_parties(spark, sf_dir), F.col("mix"))


def _expanded(spark, sf_dir):
    return owners.expand(owners.beneath(_parties(spark, sf_dir), F.col("mix")), max_addresses=4, max_txs=3)


def expand_entity(spark, sf_dir):
    """Every owner's first addresses and transactions, with totals of what isn't shown."""
    return _expanded(spark, sf_dir)[0]


def entity_links(spark, sf_dir):
    return _expanded(spark, sf_dir)[1]


def campaigns(spark, sf_dir):
    """Components among flagged addresses only (those of small parts), with their sizes: one row a member."""
    flagged = b.table(spark, sf_dir, "part").where("p_size <= 30").select(F.concat(F.lit("A"), "p_partkey").alias("part"))
    rows = weekly(spark, sf_dir)
    pairs = graph.co_spend_edges(rows, _mixes(rows))
    for end in ("a", "b"):
        pairs = pairs.join(flagged, F.substring_index(end, "@", 1) == F.col("part"), "left_semi")
    found = cut(graph.components(cut(pairs)))
    return found.join(found.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root").select("root", "n", "node")


def _seeds(edges):
    """The watched wallets: those with an id divisible by 100."""
    ends = edges.select(F.col("src").alias("entity")).unionByName(edges.select(F.col("dst").alias("entity")))
    return ends.where("cast(substring(entity, 2) as bigint) % 100 = 0").distinct()


def spread_hops(spark, sf_dir):
    e = _edges(spark, sf_dir)
    found = graph.spread(e, cut(_seeds(e)))
    return found.select("entity", "seed", F.col("hops").cast("long").alias("hops"), "direction", "parent", "risk")


def khop(spark, sf_dir):
    e = _edges(spark, sf_dir)
    found = graph.khop(e, cut(_seeds(e)), hops=2)
    return found.select("entity", F.col("hop").cast("long").alias("hop"), "capped")


def degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


def clustering(spark, sf_dir):
    return graph.clustering(_edges(spark, sf_dir))


def pagerank(spark, sf_dir):
    return graph.pagerank(_edges(spark, sf_dir), rounds=4).withColumn("rank", F.round("rank", 10))


def kcore(spark, sf_dir):
    return graph.core_numbers(_edges(spark, sf_dir))


def coinjoin_shape(spark, sf_dir):
    return utxo.coinjoins(_rounded(spark, sf_dir), min_equal=2, min_share=0.25)


def _rounded(spark, sf_dir):
    """Transactions with amounts in steps, so that some are equal."""
    step = lambda x: F.struct(x.address.alias("address"), F.floor(x.amount / 1_000_000).cast("long").alias("amount"))
    return b.utxo(spark, sf_dir).withColumn("outputs", F.transform("outputs", step))


def _sides(spark, sf_dir):
    """(inputs, outputs): one row for each address of a transaction."""
    lines = b.table(spark, sf_dir, "lineitem")
    price, tax = b.cents(F.col("l_extendedprice")), b.cents(F.col("l_extendedprice") * F.col("l_tax"))
    put = lines.groupBy(F.concat(F.lit("X"), "l_orderkey").alias("txid"), F.concat(F.lit("A"), "l_partkey").alias("address")).agg(F.sum(price + tax).alias("amount"))
    out = lines.groupBy(F.concat(F.lit("X"), "l_orderkey").alias("txid"), F.concat(F.lit("B"), "l_suppkey").alias("address")).agg(F.sum(price).alias("amount"))
    return put, out


def utxo_shares(spark, sf_dir):
    return utxo.shares(*_sides(spark, sf_dir))


def utxo_in(spark, sf_dir):
    put, out = _sides(spark, sf_dir)
    return utxo.received(put, out)


def utxo_out(spark, sf_dir):
    return utxo.payments(b.utxo(spark, sf_dir), coinjoin_shape(spark, sf_dir))


def _outflows(spark, sf_dir):
    return b.wallet_events(spark, sf_dir).where("not is_in").select(F.col("wallet").alias("sender"), "ts", F.col("far").alias("to_addr"))


def fan_out_24h(spark, sf_dir):
    return typologies.fan_out(_outflows(spark, sf_dir))


def fan_in(spark, sf_dir):
    return typologies.fan_in(b.transfers(spark, sf_dir), 300)


def rapid_forwarding(spark, sf_dir):
    events = b.wallet_events(spark, sf_dir)
    return typologies.rapid(flow.fifo_pairs(events), events, share=0.5, seconds=86400 * 30)


def peel_step(spark, sf_dir):
    return typologies.peels(b.transfers(spark, sf_dir), 0.1)


def round_amounts(spark, sf_dir):
    return typologies.round_amounts(b.transfers(spark, sf_dir), 50, 2, 0.02)


def _indicators(spark, sf_dir):
    """Every payment as one indicator of its sender."""
    codes = ["fan_out", "peel", "round", "mixer", "sanctioned"]
    at = F.col("amount") % 5
    return b.transfers(spark, sf_dir).select(
        F.col("from_addr").alias("wallet"), b._pick(codes, at).alias("code"), (F.lit(3) + F.col("amount") % 13 + F.when(at >= 3, 20).otherwise(0)).cast("long").alias("points"),
        (at < 3).alias("is_pattern"), "tx_hash",
    )


def risk_merge(spark, sf_dir):
    return typologies.merge_indicators(_indicators(spark, sf_dir))


def risk_total(spark, sf_dir):
    return typologies.risk_total(risk_merge(spark, sf_dir))


def risk_flows(spark, sf_dir):
    return typologies.risk_flows(_indicators(spark, sf_dir))


def fan_out_flags(spark, sf_dir):
    """Wallets that pay five others or more within a day."""
    return typologies.fan_out(_outflows(spark, sf_dir)).where(F.col("most") >= typologies.FAN_OUT)


def fan_in_5(spark, sf_dir):
    return typologies.fan_in(b.transfers(spark, sf_dir), typologies.FAN_IN)


def rapid_flags(spark, sf_dir):
    events = b.wallet_events(spark, sf_dir)
    return typologies.rapid(flow.fifo_pairs(events), events)


def peel_70(spark, sf_dir):
    return typologies.peels(b.transfers(spark, sf_dir))


def round_100(spark, sf_dir):
    """Wallets whose stablecoin payments are often whole hundreds of units, counted in cents."""
    return typologies.round_amounts(b.transfers(spark, sf_dir), 100 * 100)


QUERIES = {
    f.__name__: f
    for f in (
        components_week, campaigns, resolve_entities, owner_merges, expand_entity, entity_links, spread_hops, khop, degree, clustering, pagerank, kcore, coinjoin_shape, utxo_shares, utxo_in, utxo_out,
        fan_out_24h, fan_in, rapid_forwarding, peel_step, round_amounts, risk_merge, risk_total, risk_flows, fan_out_flags, fan_in_5, rapid_flags, peel_70, round_100,
    )
}

_E = "e as (select from_addr as src, to_addr as dst, sum(amount)::bigint as value from transfers where from_addr <> to_addr group by all)"
_MIX = """mb as (select txid, v, count(*) as n from (select txid, unnest(amounts) as v from utxo) group by all),
    mx as (select distinct utxo.txid from utxo join mb using (txid) where n >= 3 and n >= 0.5 * len(amounts) and len(list_distinct(inputs)) >= n
           and not exists (select 1 from mb o where o.txid = utxo.txid and (o.n, o.v) > (mb.n, mb.v)))"""
_STAR = f"""{_MIX}, wk as (select *, '@' || strftime(date_trunc('week', ts), '%Y%m%d') as k from utxo where txid not in (from mx)),
    p as materialized (select distinct a, b from (select inputs[1] || k as a, unnest(inputs) || k as b from wk) where a <> b)"""
_CRC = """list_reduce(flatten(list_transform(string_split(regexp_extract(x, '(\\d+)@', 1), ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda crc, c: case when c >= 0 then xor(crc, c) when crc & 1 = 1 then xor(crc >> 1, 3988292384) else crc >> 1 end, 4294967295::bigint)"""
# the script of an address by its first letters, the owner's first sight of an output, stars around the first input
_OWN = f"""{_MIX}, ad as materialized (select x, ['1', '3', 'bc1q', 'bc1p'][xor(4294967295, {_CRC}) % 4 + 1] as kind from (
        select distinct unnest(list_concat(inputs, addresses)) || '@' || strftime(date_trunc('week', ts), '%Y%m%d') as x from utxo)),
    si as (select u.txid, u.ts, j, ad.kind || ad.x as address, ad.kind from (select txid, ts, unnest(inputs) as z, generate_subscripts(inputs, 1) as j from utxo) u
           join ad on ad.x = z || '@' || strftime(date_trunc('week', ts), '%Y%m%d')),
    so as materialized (select u.txid, u.ts, n, ad.kind || ad.x as address, ad.kind from (select txid, ts, len(addresses) as n, unnest(addresses) as z from utxo) u
           join ad on ad.x = z || '@' || strftime(date_trunc('week', ts), '%Y%m%d')),
    hd as (select txid, address as a, kind from si where j = 1 and txid not in (from mx)),
    fs as (select address, arg_min(txid, row(ts, txid)) as txid from so group by address),
    ch as (select so.txid, count(*) as n, min(so.address) as b from so join hd using (txid) join fs on fs.address = so.address and fs.txid = so.txid
           where so.n between 2 and 6 and so.kind = hd.kind group by so.txid),
    mg as materialized (select distinct txid, a, address as b, 'co_spend' as rule from si join hd using (txid) where address <> a
        union all select txid, a, b, 'change' from ch join hd using (txid) where n = 1 and a <> b)"""
_REACH = "r(node, root) as (select a, a from {p} union select b, b from {p} union select x.b, r.root from r join (select a, b from {p} union all select b, a from {p}) x on x.a = r.node)"
_SEEDS = "s as (select distinct entity from (select src as entity from e union all select dst from e) where substr(entity, 2)::bigint % 100 = 0)"
_BOTH = "b as (select src, dst, 'down' as direction from e union all select dst, src, 'up' from e), hub as (select src as entity from b group by 1 having count(distinct dst) >= 200)"
_SPREAD = ", ".join(
    f"""l{k} as (select * exclude (n) from (select dst as entity, seed, {k} as hops, b.direction, src as parent, row_number() over (partition by dst order by seed, b.direction, src) as n
        from l{k - 1} l join b on entity = src {"" if k == 1 else "and b.direction = l.direction"} where entity not in (select entity from hub) and dst not in ({" union all ".join(f"select entity from l{i}" for i in range(k))})) where n = 1)"""
    for k in (1, 2, 3)
)
_PR = ["r0 as (select entity, 1.0::double / count(*) over () as rank from n)"] + [
    f"""g{k} as (select dst as entity, sum(w * rank) as got from sh join r{k - 1} on src = entity group by 1),
    r{k} as (select n.entity, (1 - 0.85) / (select count(*) from n) + 0.85 * (coalesce(got, 0) + (1 - (select sum(got) from g{k})) / (select count(*) from n)) as rank from n left join g{k} using (entity))"""
    for k in range(1, 5)
]
_SIDES = """pu as (select 'X' || l_orderkey as txid, 'A' || l_partkey as address, sum(round(l_extendedprice * 100)::bigint + round(l_extendedprice * l_tax * 100)::bigint)::bigint as amount from lineitem group by all),
    po as (select 'X' || l_orderkey as txid, 'B' || l_suppkey as address, sum(round(l_extendedprice * 100)::bigint)::bigint as amount from lineitem group by all)"""
_CJ = """u as (select txid, inputs, addresses, list_transform(amounts, lambda x: x // 1000000) as am from utxo),
    k as (select txid, v, count(*) as n from (select txid, unnest(am) as v from u) group by all),
    kb as (select txid, v, n from (select *, row_number() over (partition by txid order by n desc, v desc) as i from k) where i = 1),
    cj as (select txid, v as equal_value, n as n_equal, len(inputs)::bigint as n_inputs, n >= 2 and n >= 0.25 * len(am) and len(inputs) >= n as is_coinjoin from u join kb using (txid))"""
_IND = """i as (select from_addr as wallet, ['fan_out', 'peel', 'round', 'mixer', 'sanctioned'][amount % 5 + 1] as code, (3 + amount % 13 + case when amount % 5 >= 3 then 20 else 0 end)::bigint as points,
        amount % 5 < 3 as is_pattern, tx_hash from transfers)"""
_CLASS = "case when score >= 75 then 'severe' when score >= 50 then 'high' when score >= 25 then 'medium' else 'low' end"

_OWNED = f"""with {_OWN}, ed as materialized (select distinct a, b from mg), {_REACH.format(p='ed')},
    c as (select node, min(root) as root from r group by node), al as (select address from si union select address from so),
    ow as materialized (select address, coalesce(root, address) as entity, row_number() over (partition by coalesce(root, address) order by address) as k from al left join c on node = address),
    tv as (select txid, sum(amount)::bigint as value from (select txid, unnest(amounts) as amount from utxo) group by txid),
    th as materialized (select distinct entity, si.address, si.txid, ts, 'spends' as kind from si join ow using (address) union all select distinct entity, so.address, so.txid, ts, 'pays' from so join ow using (address)),
    ft as materialized (select *, row_number() over (partition by entity order by ts, txid) as k, count(*) over (partition by entity) as n from (select distinct entity, txid, ts from th))"""

ORACLES = {
    "expand_entity": b.sql("utxo", f"""{_OWNED} select entity, n_addresses, coalesce(n, 0) as n_transactions, addresses, coalesce(txs, '') as transactions, n_addresses > 4 or coalesce(n, 0) > 3 as truncated
        from (select entity, count(*) as n_addresses, string_agg(address, ',' order by k) filter (k <= 4) as addresses from ow group by entity)
        left join (select entity, max(n) as n, string_agg(txid, ',' order by k) filter (k <= 3) as txs from ft group by entity) using (entity)"""),
    "entity_links": b.sql("utxo", f"{_OWNED} select th.entity, th.address, th.txid, kind from th join ow on ow.address = th.address and ow.k <= 4 join ft on ft.entity = th.entity and ft.txid = th.txid and ft.k <= 3"),
    "owner_merges": b.sql("utxo", f"with {_OWN} select * from mg"),
    "resolve_entities": b.sql("utxo", f"""with {_OWN}, ed as materialized (select distinct a, b from mg), {_REACH.format(p='ed')},
        c as (select node, min(root) as root from r group by node), al as (select address from si union select address from so),
        f as (select address, coalesce(root, address) as entity from al left join c on node = address) select address, entity, count(*) over (partition by entity) as n from f"""),
    "components_week": b.sql("utxo", f"with {_STAR}, {_REACH.format(p='p')} select node, min(root) as root from r group by node"),
    "campaigns": b.sql("utxo", f"""with {_STAR}, fl as (select 'A' || p_partkey as part from part where p_size <= 30),
        f as materialized (select * from p where split_part(a, '@', 1) in (select part from fl) and split_part(b, '@', 1) in (select part from fl)), {_REACH.format(p='f')},
        c as (select node, min(root) as root from r group by node) select root, count(*) over (partition by root) as n, node from c"""),
    "spread_hops": b.sql("transfers", f"""with {_E}, {_SEEDS}, {_BOTH}, l0 as (select entity, entity as seed, 0 as hops, 'seed' as direction, null::varchar as parent from s), {_SPREAD}
        select entity, seed, hops::bigint as hops, direction, parent, pow(0.5, hops) as risk from ({" union all ".join(f"from l{k}" for k in range(4))})"""),
    "khop": b.sql("transfers", f"""with {_E}, {_SEEDS}, b as (select src, dst, value from e union all select dst, src, value from e), n0 as (select count(*) as n from s),
        c1 as (select dst as entity, sum(value) as v from s join b on entity = src where dst not in (select entity from s) group by 1),
        l1 as materialized (select entity from (select *, row_number() over (order by v desc, entity) as i from c1), n0 where i <= 1500 - n), n1 as (select (select n from n0) + count(*) as n from l1),
        c2 as (select dst as entity, sum(value) as v from l1 join b on entity = src where dst not in (select entity from s) and dst not in (select entity from l1) group by 1),
        l2 as (select entity from (select *, row_number() over (order by v desc, entity) as i from c2), n1 where i <= 1500 - n),
        x as (select (select count(*) from c1) + (select n from n0) > 1500 or (select count(*) from c2) + (select n from n1) > 1500 as capped)
        select h.*, capped from (select entity, 0::bigint as hop from s union all select entity, 1 from l1 union all select entity, 2 from l2) h, x"""),
    "degree": b.sql("transfers", f"""with {_E} select entity, count(*) filter (o) as degree_out, count(*) filter (not o) as degree_in, coalesce(sum(value) filter (o), 0)::bigint as wdegree_out,
        coalesce(sum(value) filter (not o), 0)::bigint as wdegree_in from (select src as entity, value, true as o from e union all select dst, value, false from e) group by entity"""),
    "clustering": b.sql("transfers", f"""with {_E}, u as (select distinct least(src, dst) as a, greatest(src, dst) as b from e), n as (select a, b from u union all select b, a from u),
        d as (select a as entity, count(*) as degree from n group by 1),
        t as (select x.a as entity, count(*) as triangles from n x join n y on x.a = y.a and x.b < y.b join u on u.a = x.b and u.b = y.b group by 1)
        select entity, degree, coalesce(triangles, 0) as triangles, case when degree > 1 then round(2 * coalesce(triangles, 0) / (degree * (degree - 1)), 6) else 0 end as coefficient from d left join t using (entity)"""),
    "pagerank": b.sql("transfers", f"""with {_E}, n as (select src as entity from e union select dst from e), sh as (select src, dst, value / sum(value) over (partition by src) as w from e), {", ".join(_PR)}
        select entity, round(rank, 10) as rank from r4"""),
    "coinjoin_shape": b.sql("utxo", f"with {_CJ} select * from cj"),
    "utxo_shares": f"""with {_SIDES}, t as (select *, sum(amount) over (partition by txid) as total from pu),
        m as (select t.txid, t.address, t.amount as put, sum((po.amount::hugeint * t.amount) // total)::bigint as paid from t join po using (txid) group by all)
        select txid, address, paid, put - paid as fee_share from m""",
    "utxo_in": f"""with {_SIDES}, f as (select txid, arg_min(address, row(-amount, address)) as sender from pu group by 1)
        select po.txid, sender, po.address as to_addr, po.amount - coalesce(pu.amount, 0) as amount from po join f using (txid) left join pu on pu.txid = po.txid and pu.address = po.address
        where po.amount - coalesce(pu.amount, 0) > 0""",
    "utxo_out": b.sql("utxo", f"""with {_CJ}, x as (select u.txid, inputs, list_distinct(list_filter(addresses, lambda a: not list_contains(inputs, a))) as ends, is_coinjoin from u join cj using (txid)),
        y as (select *, case when is_coinjoin then 'coinjoin' when len(ends) = 0 then 'self' when len(inputs) = 1 and len(ends) = 1 then 'certain' when len(inputs) = 1 then 'split' else 'pooled' end as certainty from x)
        select txid, case when certainty <> 'coinjoin' and len(inputs) = 1 then inputs[1] end as funder, case when certainty <> 'coinjoin' and len(ends) = 1 then ends[1] end as to_addr, certainty from y"""),
    "fan_out_24h": b.sql("wallet_events", """with o as (select wallet as sender, ts, far from wallet_events where not is_in),
        c as (select x.sender, x.ts, count(distinct y.far) as n from o x join o y on x.sender = y.sender and y.ts between x.ts - interval 24 hour and x.ts group by all)
        select sender, max(n) as most from c group by sender"""),
    "fan_in": b.sql("transfers", "select to_addr as wallet, count(distinct from_addr) as n_senders from transfers where from_addr <> to_addr group by 1 having count(distinct from_addr) >= 300"),
    "peel_step": b.sql("transfers", """with s as (select from_addr as wallet, to_addr, sum(amount) as v from transfers where from_addr <> to_addr group by all),
        p as (select wallet, count(*) as n_recipients, arg_max(to_addr, row(v, to_addr)) as main, round(max(v) / sum(v), 6) as main_share from s group by 1) select * from p where n_recipients >= 2 and main_share >= 0.1"""),
    "round_amounts": b.sql("transfers", """select from_addr as wallet, count(*) filter (amount % 50 = 0) as n_round, count(*) as n from transfers where asset <> 'COIN' group by 1
        having count(*) filter (amount % 50 = 0) >= 2 and count(*) filter (amount % 50 = 0) >= 0.02 * count(*)"""),
    "risk_merge": b.sql("transfers", f"with {_IND} select wallet, code, max(points) as points, bool_or(is_pattern) as is_pattern, count(distinct tx_hash) as n_txs from i group by all"),
    "risk_total": b.sql("transfers", f"""with {_IND}, m as (select wallet, code, max(points) as points, bool_or(is_pattern) as p from i group by all),
        t as (select wallet, least(100, least(20, coalesce(sum(points) filter (p), 0)) + coalesce(sum(points) filter (not p), 0))::bigint as score from m group by 1) select wallet, score, {_CLASS} as class from t"""),
    "risk_flows": b.sql("transfers", f"""with {_IND}, m as (select tx_hash, code, max(points) as points from i group by all), t as (select tx_hash, least(100, sum(points))::bigint as score from m group by 1)
        select tx_hash, score, {_CLASS} as class from t"""),
    "fan_out_flags": b.sql("wallet_events", """with o as (select wallet as sender, ts, far from wallet_events where not is_in),
        c as (select x.sender, x.ts, count(distinct y.far) as n from o x join o y on x.sender = y.sender and y.ts between x.ts - interval 24 hour and x.ts group by all)
        select sender, max(n) as most from c group by sender having max(n) >= 5"""),
    "fan_in_5": b.sql("transfers", "select to_addr as wallet, count(distinct from_addr) as n_senders from transfers where from_addr <> to_addr group by 1 having count(distinct from_addr) >= 5"),
    "peel_70": b.sql("transfers", """with s as (select from_addr as wallet, to_addr, sum(amount) as v from transfers where from_addr <> to_addr group by all),
        p as (select wallet, count(*) as n_recipients, arg_max(to_addr, row(v, to_addr)) as main, round(max(v) / sum(v), 6) as main_share from s group by 1) select * from p where n_recipients >= 2 and main_share >= 0.7"""),
    "round_100": b.sql("transfers", """select from_addr as wallet, count(*) filter (amount % 10000 = 0) as n_round, count(*) as n from transfers where asset <> 'COIN' group by 1
        having count(*) filter (amount % 10000 = 0) >= 3 and count(*) filter (amount % 10000 = 0) >= 0.5 * count(*)"""),
    "rapid_forwarding": b.sql("wallet_events", """with i as (select wallet, event_id as in_id, ts as in_ts, sum(amount) over w - amount as a, sum(amount) over w as b from wallet_events where is_in and amount > 0
            window w as (partition by wallet order by ts, event_id rows unbounded preceding)),
        o as (select wallet, event_id as out_id, ts as out_ts, sum(amount) over w - amount as a, sum(amount) over w as b from wallet_events where not is_in and amount > 0
            window w as (partition by wallet order by ts, event_id rows unbounded preceding)),
        p as (select i.wallet, (least(i.b, o.b) - greatest(i.a, o.a))::bigint as amount, floor((epoch_us(out_ts) - epoch_us(in_ts)) / 1000000)::bigint as wait_s
              from i join o on i.wallet = o.wallet and i.a < o.b and o.a < i.b),
        u as (select wallet, sum(amount)::bigint as forwarded, max(wait_s) filter (wait_s >= 0) as slow, max((wait_s < 0)::int) as early from p group by 1),
        g as (select wallet, sum(amount)::bigint as received from wallet_events where is_in group by 1)
        select wallet, forwarded, received, case when early = 0 then slow end as slowest_s, early = 0 and forwarded >= received * 0.5 and slow <= 86400 * 30 as rapid from g join u using (wallet)"""),
}
ORACLES["rapid_flags"] = ORACLES["rapid_forwarding"].replace("received * 0.5", "received * 0.9").replace("86400 * 30", "600")
