"""Queries on what traces say: risk from their indicators, why nobody is named, next steps; and entities' feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import attribution, edges, features, flow, graph
from flowlens.plans import binding as b
from flowlens.plans import q_features, q_flow, q_graph
from flowlens.session import cut


def _frozen(spark, sf_dir):
    """Wallets whose owners owe: customers with the least balances."""
    return b.table(spark, sf_dir, "customer").where("c_acctbal < -900").select(F.concat(F.lit("W"), "c_custkey").alias("address"))


def _lists(spark, sf_dir):
    """Wallets with a threat tag, and those on a scam list: some of the customers."""
    c = b.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("W"), "c_custkey").alias("address"))
    return cut(c.where("c_custkey % 23 = 3").select("address")), cut(c.where("c_custkey % 29 = 5").select("address"))


def _found(spark, sf_dir):
    read = q_flow.given(spark, sf_dir)
    out, holds, _ = q_flow.traced(spark, sf_dir, read=read)
    into = q_flow.traced(spark, sf_dir, 1, inbound=True, read=read)[0]
    return cut(attribution.indicators(q_flow.kept_edges(out), into, holds, read[1], cut(_frozen(spark, sf_dir)), *_lists(spark, sf_dir)))


def case_indicators(spark, sf_dir):
    return attribution.merged(_found(spark, sf_dir)).select("origin", "code", "points", "is_pattern", "wallet", "n")


def case_risk(spark, sf_dir):
    return attribution.case_risk(_found(spark, sf_dir))


def wallet_risk(spark, sf_dir):
    return attribution.wallet_risk(q_flow.trace_labels(spark, sf_dir), _frozen(spark, sf_dir), _found(spark, sf_dir), *_lists(spark, sf_dir))


def self_candidates(spark, sf_dir):
    return attribution.self_candidates(q_flow.origins(q_flow.moves(spark, sf_dir)), q_flow.trace_labels(spark, sf_dir))


def where_it_stopped(spark, sf_dir):
    return attribution.where_it_stopped(q_flow.traced(spark, sf_dir)[1])


def abstain(spark, sf_dir):
    out, holds, _ = q_flow.traced(spark, sf_dir)
    names = cut(q_flow.trace_labels(spark, sf_dir))
    return attribution.abstained(flow.outcome(out, names), flow.candidates(out, names), cut(attribution.where_it_stopped(holds)))


def counter_verdicts(spark, sf_dir):
    """The nearest named service with the label hidden where most of its money came in: is it still named?"""
    read = q_flow.given(spark, sf_dir)
    out, holds, _ = q_flow.traced(spark, sf_dir, read=read)
    names = read[1]
    before = cut(flow.candidates(out, names))
    named = before.where(F.col("confidence") >= flow.NAMED_FROM).groupBy("origin").agg(F.min_by("entity", "rank").alias("entity"))
    top = cut(named.join(flow.entries(out, names), ["origin", "entity"]))
    again, later, _ = q_flow.traced(spark, sf_dir, hidden=top, read=read)
    return attribution.verdicts(top, before, flow.candidates(again, names, top), holds, later)


def bridge_steps(spark, sf_dir):
    return attribution.bridge_steps(q_flow.traced(spark, sf_dir)[0], q_flow.trace_labels(spark, sf_dir))


def crossing_words(spark, sf_dir):
    from flowlens.plans import q_discovery

    return attribution.crossing_words(q_discovery.bridge_crossings(spark, sf_dir))


def model_items(spark, sf_dir):
    s = b.table(spark, sf_dir, "supplier")
    reason = lambda name, effect: F.struct(F.lit(name).alias("name"), effect.alias("effect"))
    model = F.to_json(F.struct((F.col("s_suppkey") % 100 / 100).alias("p"), F.array(reason("far", F.col("s_nationkey") / 4), reason("old", F.lit(0.5))).alias("reasons")))
    return attribution.model_items(s.select(F.concat(F.lit("W"), "s_suppkey").alias("address"), F.when(F.col("s_acctbal") > 0, model).alias("model")))


def _sent(spark, sf_dir):
    return b.transfers(spark, sf_dir).select(F.col("from_addr").alias("entity"), F.col("block_time").alias("ts"), F.col("tx_hash").alias("row_id"), "amount")


def entity_matrix(spark, sf_dir):
    """One row an entity: degrees, counterparties, times and hours of its payments, clustering; gaps are null."""
    e, sent = cut(q_features.entity_edges(spark, sf_dir)), cut(_sent(spark, sf_dir))
    return features.matrix([graph.degrees(e), edges.counterparties(e), features.temporal_gaps(sent), features.hourly_features(sent), graph.clustering(e)])


QUERIES = {f.__name__: f for f in (case_indicators, case_risk, wallet_risk, self_candidates, where_it_stopped, abstain, counter_verdicts, bridge_steps, crossing_words, model_items, entity_matrix)}

_IN = q_flow._trace(1, p="i", inbound=True)
_PTS = "case code " + " ".join(f"when '{k}' then {v[0]}" for k, v in attribution.POINTS.items()) + " end"
_EXTRA = "case code " + " ".join(f"when '{k}' then {v[1]}" for k, v in attribution.POINTS.items()) + " end"
_RISK = f"""{q_flow._ALL}, {_IN},
    fz as (select 'W' || c_custkey as wallet from customer where c_acctbal < -900), kd as (select address as wallet, category from l where category in ('sanctioned', 'mixer', 'bridge', 'swap')),
    po as materialized (select origin, to_addr as wallet, sum(traced) as amount, min(hop) as hops from e group by all), pi as (select origin, from_addr as wallet, sum(traced) as amount, min(hop) as hops from ie group by all),
    mo as (select origin, wallet, category, amount / total as share, hops from po join kd using (wallet) join t using (origin)),
    pv as (select origin, from_addr as wallet, to_addr, sum(traced) as v from e group by all),
    pc as materialized (select m.origin, m.wallet, main from (select origin, wallet, count(*) as n, max(v) as v, arg_max(to_addr, row(v, to_addr)) as main from pv group by all) m join po on po.origin = m.origin and po.wallet = m.wallet
        where n >= 2 and v >= 0.7 * amount and m.wallet <> m.origin),
    oo as (select distinct origin from e),
    threat_list as (select 'W' || c_custkey as wallet from customer where c_custkey % 23 = 3), scam_list as (select 'W' || c_custkey as wallet from customer where c_custkey % 29 = 5),
    threat_only as (select wallet from threat_list where wallet not in (select wallet from kd where category in ('sanctioned', 'mixer'))), scam_only as (select wallet from scam_list where wallet not in (select wallet from threat_list)),
    fi as (select origin, case category when 'bridge' then 'bridge_hop' when 'swap' then 'swap_service' else category || '_contact' end as code, wallet, share, hops from mo
        union all select pi.origin, category || '_funding', pi.wallet, amount / total, 1 from pi join kd using (wallet) join it using (origin) where category in ('sanctioned', 'mixer') and not exists (select 1 from mo where mo.origin = pi.origin and mo.wallet = pi.wallet)
        union all select origin, category || '_self', origin, 0, 1 from oo join kd on kd.wallet = origin where category in ('sanctioned', 'mixer')
        union all select origin, 'frozen_contact', wallet, amount / total, hops from po join fz using (wallet) join t using (origin) where wallet <> origin
        union all select origin, 'frozen_funding', wallet, amount / total, hops from pi join fz using (wallet) join it using (origin) where wallet <> origin
        union all select origin, 'frozen_self', origin, 0, 1 from oo join fz on fz.wallet = origin
        union all select origin, 'threat_contact', wallet, amount / total, hops from po join threat_only using (wallet) join t using (origin) where wallet <> origin
        union all select pi.origin, 'threat_funding', pi.wallet, amount / total, 1 from pi join threat_only using (wallet) join it using (origin) where pi.wallet <> pi.origin and not exists (select 1 from po where po.origin = pi.origin and po.wallet = pi.wallet)
        union all select origin, 'threat_self', origin, 0, 1 from oo join threat_only on wallet = origin
        union all select origin, 'scam_self', origin, 0, 1 from oo join scam_only on wallet = origin
        union all select origin, 'scam_contact', wallet, 0, 1 from (select origin, wallet from po union select origin, wallet from pi) join scam_only using (wallet) where wallet <> origin
        union all select origin, 'unlabelled_hub', null, 0, 1 from (select origin, sum(held) as held from h where reason = 'hub' group by 1) join t using (origin) where held >= 0.5 * total
        union all select origin, 'fan_out', wallet, 0, 1 from (select distinct x.origin, x.from_addr as wallet from (select x.origin, x.from_addr, x.block_time, count(distinct y.to_addr) as n from e x join e y on x.origin = y.origin and x.from_addr = y.from_addr
            and y.block_time between x.block_time - interval 24 hour and x.block_time group by all) x where n >= 5)
        union all select origin, 'fan_in', origin, 0, 1 from ie where hop = 1 group by origin having count(distinct from_addr) >= 5
        union all select origin, 'fan_in', to_addr, 0, 1 from e where from_addr <> origin and to_addr <> origin group by origin, to_addr having count(distinct from_addr) >= 3
        union all select origin, 'round_amounts', origin, 0, 1 from e where hop = 1 and asset <> 'COIN' group by origin having count(*) filter (amount >= 10000 and amount % 10000 = 0) >= greatest(3, 0.5 * count(*))
        union all select origin, 'peel_chain', wallet, 0, 1 from pc where exists (select 1 from pc n where n.origin = pc.origin and n.wallet = pc.main)),
    fd as materialized (select origin, code, wallet, least(100, {_PTS} + round_even(({_EXTRA}) * least(1.0, greatest(0.0, share)) * case when hops <= 1 then 1.0 when hops = 2 then 0.8 else 0.6 end, 0)::int)::int as points,
        code in ('peel_chain', 'fan_out', 'fan_in', 'round_amounts') as is_pattern from fi),
    mg as (select origin, code, max(points) as points, bool_or(is_pattern) as is_pattern, arg_min(coalesce(wallet, ''), row(-points, coalesce(wallet, ''))) as wallet, count(*) as n from fd group by all)"""
_SCORE = "least(100, least(20, coalesce(sum(points) filter (is_pattern), 0)) + coalesce(sum(points) filter (not is_pattern), 0))::bigint"
_SENT = "select from_addr as wallet, tx_hash as event_id, block_time as ts, amount from transfers"
_STOPS = "case reason " + " ".join(f"when '{k}' then '{v}'" for k, v in attribution.STOPPED.items()) + " end"
_STOP = f"""hw as (select origin, reason, wallet, sum(held) as held from h where held > 0 group by all), ht as (select *, row_number() over (partition by origin, reason order by held desc, wallet) as i from hw),
    hs as (select *, held / sum(held) over (partition by origin) as share from (select origin, reason, sum(held) as held from hw group by all)),
    st as (select origin, reason, round(share, 6) as share, floor(share * 100 + 0.5)::bigint || '% of the money ' || {_STOPS} as text, hints from hs join (select origin, reason, string_agg(wallet, ', ' order by i) filter (i <= 2) as hints from ht group by all) using (origin, reason))"""
_OUTCOME = q_flow.ORACLES["outcome"]
_OUT = _OUTCOME[_OUTCOME.index("n as (select origin, arg_min(entity, rank)") : _OUTCOME.rindex("select origin, outcome")].rstrip().rstrip(",")


def _on_sent(name: str) -> str:
    return "(" + q_features.ORACLES[name].replace(b.SQL["wallet_events"], _SENT).replace("with wallet_events as", f"with transfers as ({b.SQL['transfers']}), wallet_events as").replace("with recursive wallet_events as", f"with transfers as ({b.SQL['transfers']}), wallet_events as") + ")"


_HHI = q_features.ORACLES["counterparty_hhi"]

ORACLES = {
    "case_indicators": b.sql("transfers labels", f"{_RISK} select origin, code, points, is_pattern, nullif(wallet, '') as wallet, n from mg"),
    "case_risk": b.sql("transfers labels", f"""{_RISK}, sc as (select origin, {_SCORE} as score, count(*) as n_indicators from mg group by origin)
        select origin, score, {q_graph._CLASS} as class, n_indicators from sc"""),
    "wallet_risk": b.sql("transfers labels", f"""{_RISK}, ow as (select address as wallet, category || '_self' as code from l where category in ('sanctioned', 'mixer') union all select wallet, 'threat_self' from threat_only union all select wallet, 'scam_self' from scam_only union all select wallet, 'frozen_self' from fz),
        al as (select wallet, code, {_PTS} as points, false as is_pattern from ow union all select origin, code, points, is_pattern from fd), am as (select wallet, code, max(points) as points, bool_or(is_pattern) as is_pattern from al group by all),
        sc as (select wallet, {_SCORE} as score from am group by wallet) select wallet, score, {q_graph._CLASS} as class from sc"""),
    "self_candidates": b.sql("transfers labels", f"with {q_flow._MOVES}, {q_flow._OG} select origin, entity, (case tier when 'published_por' then 0.95 when 'curated' then 0.85 when 'explorer_tag' then 0.75 else 0.6 end)::double as confidence from og join labels_rel on origin = address where category in ('exchange', 'swap')"),
    "where_it_stopped": b.sql("transfers labels", f"{q_flow._ALL}, {_STOP} select * from st"),
    "abstain": b.sql("transfers labels", f"""{q_flow._ALL}, {q_flow._CAND}, {_OUT}, {_STOP}, no as (select origin from o where outcome = 'INSUFFICIENT_EVIDENCE'),
        bs as (select origin, arg_max(entity, row(confidence, -rank)) as be, arg_max(share, row(confidence, -rank)) as bsh, arg_max(confidence, row(confidence, -rank)) as bc from cc group by 1),
        ms as (select origin, arg_max(reason, row(share, reason)) as reason from st where reason <> 'labelled' group by 1),
        j as (select no.origin, be, bsh, bc, reason, case when be is null then 'no_service' when bsh < 0.25::double * 0.6::double then 'small_share' else 'weak_evidence' end as why from no left join bs using (origin) left join ms using (origin))
        select origin, why, case why when 'no_service' then 'The money was not seen to reach a service.' when 'small_share' then 'Only ' || floor(bsh * 100 + 0.5)::bigint || '% of the money reached ' || be || '.'
            else 'The evidence for ' || be || ' is ' || floor(bc * 100 + 0.5)::bigint || '%, under the bar.' end as text,
            coalesce(case reason when 'depth_limit' then 'Trace further.' when 'hub' then 'Ask who runs the busy wallet.' when 'kept' then 'Watch the wallets that hold the money.' when 'small' then 'Lower the least share.'
                when 'budget' then 'Follow more wallets.' when 'truncated' then 'Read more payments.' when 'origin' then 'Trace again from a later date.' end, 'Look for more payments.') as step from j"""),
    "counter_verdicts": b.sql("transfers labels", f"""{q_flow._ALL}, {q_flow._CAND}, ent as (select e.origin, entity, to_addr as address, sum(traced) as got from e join l on e.to_addr = l.address where category in ('exchange', 'swap') group by all),
        top as materialized (select c.origin, c.entity, address, confidence as was from (select * from cc where confidence >= 0.6 qualify row_number() over (partition by origin order by rank) = 1) c
            join (select * from ent qualify row_number() over (partition by origin, entity order by got desc, address) = 1) n on n.origin = c.origin and n.entity = c.entity), {q_flow._trace(hidden="top", p="q", by="address")},
        xn as (select qe.origin, l.entity, sum(traced)::bigint as received, sum((case tier when 'published_por' then 0.95 when 'curated' then 0.85 when 'explorer_tag' then 0.75 else 0.6 end)::double * pow(0.85, hop - 1) * traced) as strength
            from qe join l on qe.to_addr = l.address join top on top.origin = qe.origin and top.entity = l.entity where category in ('exchange', 'swap') and qe.to_addr <> top.address group by all),
        xc as (select origin, entity, round(strength / received * least(1, received / total / 0.25), 4) as now from xn join qt using (origin)),
        seen1 as (select origin, reason, sum(held) as v from h group by all), seen2 as (select origin, reason, sum(held) as v from qh group by all),
        blind as (select distinct seen2.origin from seen2 left join seen1 on seen1.origin = seen2.origin and seen1.reason = seen2.reason where seen2.reason in ('depth_limit', 'budget', 'truncated', 'small', 'pooled', 'coinjoin') and seen2.v > coalesce(seen1.v, 0))
        select top.origin, top.entity, top.address, was, now, case when now >= 0.6 then 'holds' when now is not null then 'weaker' when top.origin in (select origin from blind) then 'not_checked' else 'gone' end as verdict
        from top left join xc on xc.origin = top.origin and xc.entity = top.entity"""),
    "bridge_steps": b.sql("transfers labels", f"""{q_flow._ALL}, n as (select origin, entity, count(distinct tx_hash) as n from e join l on to_addr = address where category = 'bridge' group by all)
        select origin, entity, 'Ask ' || entity || ' where ' || n || case when n = 1 then ' deposit was paid out.' else ' deposits were paid out.' end as text from n"""),
    "crossing_words": """select 'D' || o_orderkey as tx_hash, case when o_orderkey % 5 = 0 then 'not followed: the bridge names no payout' when o_orderkey % 7 = 0 then 'not followed: the payout was not found' else 'crossed to b, paid to W' || o_custkey end as text from orders""",
    "model_items": """select 'W' || s_suppkey as address, (s_suppkey % 100) / 100 as p, 'far' as reason, s_nationkey / 4 as effect from supplier where s_acctbal > 0
        union all select 'W' || s_suppkey, (s_suppkey % 100) / 100, 'old', 0.5 from supplier where s_acctbal > 0""",
    "entity_matrix": f"""select * from ({q_graph.ORACLES["degree"]}) full join (select * exclude (label) from ({_HHI})) using (entity) full join {_on_sent("temporal_gaps")} using (entity) full join {_on_sent("hourly_features")} using (entity) full join ({q_graph.ORACLES["clustering"]}) using (entity)""",
}
