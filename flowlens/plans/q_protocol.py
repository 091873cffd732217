"""Queries that draw samples, build datasets and measure rules and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import flow, protocol
from flowlens.plans import binding as b
from flowlens.plans import q_flow, q_labels
from flowlens.session import cut


def sample_customers(spark, sf_dir):
    """Up to forty customers of each nation, by lot."""
    return protocol.draw(b.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", 40)


def draw_strata(spark, sf_dir):
    """Labels of three kinds, thirty of each by lot."""
    rows = b.labels(spark, sf_dir).select("address", "entity", "category", "tier")
    kinds = {"ring": F.col("entity").rlike("^U"), "service": F.col("category").isin("exchange", "swap"), "crowd": F.col("tier") == "curated"}
    return protocol.strata(rows, kinds, "address", 30)


def model_dataset(spark, sf_dir):
    names = b.labels(spark, sf_dir)
    deposits = names.where("kind = 'deposit' and category = 'exchange'").select("address", F.col("entity").alias("group"))
    return protocol.assemble(b.transfers(spark, sf_dir).select("from_addr", "to_addr"), deposits, names.select("address"))


def hidden_group(spark, sf_dir):
    rows = b.labels(spark, sf_dir).select("address", F.col("entity").alias("label_entity"), F.lit(1).alias("to_label"), (F.col("confidence") / 100).alias("label_share"))
    return protocol.hide_group(rows, "FRANCE")


def loeo_folds(spark, sf_dir):
    return protocol.leave_one_out(b.scored(spark, sf_dir).select("idx", "y", "grp"), "grp", 14).select("idx", "fold")


def metrics_at_bar(spark, sf_dir):
    return protocol.at_bar(b.scored(spark, sf_dir), 0.5)


def metrics_by_group(spark, sf_dir):
    return protocol.at_bar(b.scored(spark, sf_dir), 0.5, ["grp"])


def queue_orderings(spark, sf_dir):
    """Three ways to order a queue side by side."""
    return protocol.orderings(b.scored(spark, sf_dir), {"score": F.col("score"), "amount": F.col("amount").cast("double"), "reverse": 1 - F.col("score")})


def class_thresholds(spark, sf_dir):
    return protocol.class_thresholds(b.scored(spark, sf_dir).withColumn("grp", F.when(F.col("toxic") == 1, "toxic").otherwise("clean")), "grp", target=0.5)


def prior_blocks(spark, sf_dir):
    return protocol.prior_blocks(b.scored(spark, sf_dir), 0.5, {"fifth": 0.2, "most": 0.8})


def _claims(spark, sf_dir):
    paid = cut(q_flow.moves(spark, sf_dir))
    names = cut(q_flow.trace_labels(spark, sf_dir))
    fewer = cut(names.where("tier <> 'published_por'"))
    full = flow.candidates(flow.trace(paid, q_flow.origins(paid), names, flow.Rules(hops=1))[0], names)
    hidden = flow.candidates(flow.trace(paid, q_flow.origins(paid), fewer)[0], fewer)
    return cut(protocol.claims(full, hidden))


def hidden_claims(spark, sf_dir):
    """What traces claim without the labels that owners published, and whether the whole labels agree."""
    return _claims(spark, sf_dir).select("origin", "entity", "rank", F.col("hops").cast("long").alias("hops"), "share", "confidence", "correct")


def abstain_grid(spark, sf_dir):
    return protocol.bar_grid(_claims(spark, sf_dir))


def model_gate(spark, sf_dir):
    return protocol.gate(b.scored(spark, sf_dir), 0.6, "grp", 0.4).drop("upper")


def split_leaks(spark, sf_dir):
    rows = protocol.leave_one_out(b.scored(spark, sf_dir).select("idx", "y", "grp"), "grp", 14)
    return protocol.leaks(rows, "fold", ["grp", "idx"])


def holders(spark, sf_dir):
    return protocol.holders(q_flow.traced(spark, sf_dir)[0], q_flow.trace_labels(spark, sf_dir))


def watch_due(spark, sf_dir):
    """Users whose last event lies two days or more before a given time, or who have none of the kind that counts."""
    e = b.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("checked"))
    return protocol.due(e, F.lit("2024-02-15").cast("timestamp"), 2 * 86400)


VERDICTS = {"agrees": "confirmed", "unlabelled": "used", "differs": "contradicted", "no_payments": "unused"}


def checked_labels(spark, sf_dir):
    """Customers' deposit tags, filed under another name or the same, after the checks of their payments."""
    verdict = F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv])[F.col("verdict")]
    checks = q_labels.tag_check(spark, sf_dir).where("cast(substring(address, 2) as bigint) % 7 <> 0").select("address", verdict.alias("verdict"))
    rows = b.table(spark, sf_dir, "customer").join(b.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    filed = F.when(F.col("c_custkey") % 5 == 0, F.lower("n_name")).otherwise(F.col("c_mktsegment"))
    label = F.when(F.col("c_custkey") % 6 != 0, F.concat("n_name", F.lit(" Dep: "), "c_name")).otherwise(F.col("c_name"))
    labels = rows.select(
        F.concat(F.lit("W"), "c_custkey").alias("address"), label.alias("label"), filed.alias("entity"), F.when(F.col("c_custkey") % 4 == 0, "exchange").otherwise("entity").alias("category"),
        F.lit("explorer").alias("source"),
    )
    return protocol.checked_tags(labels, checks)


def tag_counts(spark, sf_dir):
    """How many unresolved tags have each verdict."""
    return checked_labels(spark, sf_dir).where("verdict is not null").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.count_if("loaded").alias("loaded"))


def findings_digest(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    return protocol.digest_rows(o, "o_orderkey", ["o_totalprice", "o_orderstatus", "o_custkey"])


def verify_findings(spark, sf_dir):
    """Digests as recorded against those of the rows now: some changed, some went, some came."""
    o = b.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    was = o.where("o_orderstatus <> 'P'").withColumn("o_totalprice", F.when(F.col("o_totalprice") > 200000, 0.0).otherwise(F.col("o_totalprice")))
    columns = ["o_totalprice", "o_orderstatus"]
    now = o.where("o_totalprice > 20000")
    return protocol.verified(protocol.digest_rows(was, "o_orderkey", columns), protocol.digest_rows(now, "o_orderkey", columns), "o_orderkey")


QUERIES = {
    f.__name__: f
    for f in (
        sample_customers, draw_strata, model_dataset, hidden_group, loeo_folds, metrics_at_bar, metrics_by_group, queue_orderings, class_thresholds, prior_blocks, hidden_claims, abstain_grid,
        model_gate, split_leaks, holders, watch_due, checked_labels, tag_counts, findings_digest, verify_findings,
    )
}

_LOT = f"md5('{protocol.SEED}:' || {{}})"
_BARS = """select {by} count(*) filter (score >= 0.5 and y = 1) as tp, count(*) filter (score >= 0.5 and y = 0) as fp, count(*) filter (score < 0.5 and y = 1) as fn, count(*) filter (score < 0.5 and y = 0) as tn,
    round(avg(pow(score - y, 2)), 8) as brier from scored {group}"""
_RATES = """select *, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(fp / nullif(fp + tn, 0), 6) as false_rate, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1,
    round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) as accuracy, round((tp * tn - fp * fn)::double / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) as mcc from b"""


def _ordering(name: str, score: str) -> str:
    top = ", ".join(f"(select round(avg(y), 6) from (select y from scored order by {score} desc, idx limit {k})) as p_at_{k}" for k in (10, 25, 50))
    return f"""select '{name}' as ordering, (select round(sum(pos * tp / seen) / sum(pos), 8) from (select pos, sum(pos) over w as tp, sum(n) over w as seen from (select {score} as s, sum(y) as pos, count(*) as n from scored group by 1) window w as (order by s desc))) as pr_auc, {top}"""


def _block(name: str, prior: float) -> str:
    moved = "score" if name == "before" else f"score * {prior} / 0.5 / nullif(score * {prior} / 0.5 + (1 - score) * (1 - {prior}) / 0.5, 0)"
    return f"""select '{name}' as block, round({prior}::double, 6) as prior, round(avg(s), 6) as mean, round(avg(pow(s - y, 2)), 6) as brier, (select round(sum(n * abs(ms - my)) / sum(n), 6) from
        (select count(*) as n, round(avg(s), 8) as ms, round(avg(y), 8) as my from (select y, {moved} as s from scored) group by least(floor(s * 10), 9))) as ece from (select y, {moved} as s from scored)"""


_FEWER = q_flow._trace(p="q").replace("ql as (select * from labels_rel where category <> 'unknown')", "ql as (select * from labels_rel where category <> 'unknown' and tier <> 'published_por')")
_QCAND = q_flow._CAND.replace("cn as", "qcn as").replace("cc as", "qcc as").replace("from e join l on e.to_addr", "from qe e join ql l on e.to_addr").replace("from cn join t using", "from qcn join qt using")
_CLAIMS = f"""with {q_flow._MOVES}, {q_flow._OG}, {q_flow._trace(1)}, {q_flow._CAND}, {_FEWER}, {_QCAND},
    cl as materialized (select q.origin, q.entity, q.rank, q.hops::bigint as hops, q.share, q.confidence, exists (select 1 from cc where cc.origin = q.origin and cc.entity = q.entity and cc.hops = 1) as correct from qcc q)"""

_TAG_CHECK = q_labels.ORACLES["tag_check"]
_CHECKED = f"""with tk as (select address, case verdict when 'agrees' then 'confirmed' when 'unlabelled' then 'used' when 'differs' then 'contradicted' else 'unused' end as told from ({_TAG_CHECK})
        where substr(address, 2)::bigint % 7 <> 0),
    tl as (select 'W' || c_custkey as address, case when c_custkey % 6 <> 0 then n_name || ' Dep: ' || c_name else c_name end as label, case when c_custkey % 5 = 0 then lower(n_name) else c_mktsegment end as entity,
        case when c_custkey % 4 = 0 then 'exchange' else 'entity' end as category, n_name as owner, c_custkey % 6 <> 0 and c_custkey % 4 <> 0 and c_custkey % 5 <> 0 and n_name <> c_mktsegment as unresolved
        from customer join nation on c_nationkey = n_nationkey),
    tv as (select tl.*, case when unresolved then coalesce(told, 'unchecked') end as verdict from tl left join tk using (address)),
    ct as (select address, label, case when verdict in ('confirmed', 'used') then owner else entity end as entity,
        case when verdict in ('confirmed', 'used') then 'exchange' else category end as category, case when verdict in ('confirmed', 'used') then 'checked tag' else 'explorer' end as source,
        verdict, coalesce(verdict in ('confirmed', 'used'), false) as loaded from tv)"""

ORACLES = {
    "sample_customers": f"select c_custkey, c_nationkey from customer qualify row_number() over (partition by c_nationkey order by {_LOT.format('c_custkey')}) <= 40",
    "draw_strata": b.sql("labels", f"""select *, case when regexp_matches(entity, '^U') then 'ring' when category in ('exchange', 'swap') then 'service' when tier = 'curated' then 'crowd' end as stratum from (select address, entity, category, tier from labels_rel)
        where stratum is not null qualify row_number() over (partition by stratum order by {_LOT.format('address')}) <= 30"""),
    "model_dataset": b.sql("transfers labels", f"""with p as (select address, entity as grp from labels_rel where kind = 'deposit' and category = 'exchange'),
        o as (select from_addr as address, min(grp) as grp from transfers join p on to_addr = p.address group by 1 having count(distinct grp) = 1),
        c as (select * from o where address not in (select address from labels_rel) qualify row_number() over (partition by grp order by {_LOT.format('address')}) <= 40)
        select address, 1 as y, grp as "group" from p union all select address, 0, grp from c"""),
    "hidden_group": b.sql("labels", "select address, entity as label_entity, case when entity = 'FRANCE' then 0 else 1 end as to_label, case when entity = 'FRANCE' then 0 else confidence / 100 end as label_share from labels_rel"),
    "loeo_folds": b.sql("scored", "select idx, case when sum(y) over (partition by grp) >= 14 then grp else 'rest' end as fold from scored"),
    "metrics_at_bar": b.sql("scored", f"with b as ({_BARS.format(by='', group='')}) {_RATES}"),
    "metrics_by_group": b.sql("scored", f"with b as ({_BARS.format(by='grp,', group='group by grp')}) {_RATES}"),
    "queue_orderings": b.sql("scored", f"{_ordering('score', 'score')} union all {_ordering('amount', 'amount::double')} union all {_ordering('reverse', '(1 - score)')}"),
    "prior_blocks": b.sql("scored", f"{_block('before', 0.5)} union all {_block('fifth', 0.2)} union all {_block('most', 0.8)}"),
    "hidden_claims": b.sql("transfers labels", f"{_CLAIMS} select * from cl"),
    "abstain_grid": b.sql("transfers labels", f"""{_CLAIMS}, g as (select unnest([{', '.join(f'{t}::double' for t in protocol.GRID)}]) as bar), ba as (select bar, origin, arg_min(correct, rank) as ok from g join cl on confidence >= bar group by all)
        select bar, count(*) as answered, count(*) filter (ok) as right, round(count(*) / (select count(distinct origin) from cl), 6) as coverage, round(1 - count(*) filter (ok) / count(*), 6) as risk from ba group by bar"""),
    # the upper bound is no higher than .4 exactly if so few wrong ones would come by chance in 1 of 20 draws at .4
    "model_gate": b.sql("scored", """with g as (select grp, count(*) as held_out, sum(y)::bigint as positives, count(*) filter (score >= 0.6) as flagged, count(*) filter (score >= 0.6 and y = 0) as wrong from scored group by rollup (grp)),
        k as (select g.*, list_sum(list_transform(range(0, wrong + 1), lambda i: exp(lgamma(flagged + 1) - lgamma(i + 1) - lgamma(flagged - i + 1) + i * ln(0.4::double) + (flagged - i) * ln(0.6::double)))) as tail from g)
        select grp, held_out, positives, flagged, wrong, round(wrong / nullif(flagged, 0), 6) as error, round((flagged - wrong) / nullif(positives, 0), 6) as found, flagged >= 30 as enough,
               flagged >= 30 and tail <= 0.05 as passes from k"""),
    "split_leaks": "select * from (values ('grp', 0::bigint), ('idx', 0::bigint)) t(key, n)",
    "holders": b.sql("transfers labels", f"""{q_flow._ALL}, g as (select origin, to_addr as wallet, sum(traced) as received from e where to_addr not in (select address from l) group by all), s as (select origin, from_addr as wallet, sum(traced) as passed from e group by all)
        select origin, wallet, received::bigint as received, greatest(0, received - coalesce(passed, 0))::bigint as held, coalesce(passed, 0)::bigint as passed from g left join s using (origin, wallet)"""),
    "watch_due": "select *, checked is null as never from (select user_id as id, max(ts) filter (event_type <> 'error') as checked from events group by 1) where checked is null or timestamp '2024-02-15' - checked >= interval 2 day",
    "checked_labels": b.sql("transfers labels", f"{_CHECKED} select * from ct"),
    "tag_counts": b.sql("transfers labels", f"{_CHECKED} select verdict, count(*) as n, count(*) filter (loaded) as loaded from ct where verdict is not null group by verdict"),
    "findings_digest": "select o_orderkey, sha256('o_custkey=' || o_custkey || ';o_orderstatus=' || o_orderstatus || ';o_totalprice=' || printf('%.6f', o_totalprice)) as sha256 from orders",
    "verify_findings": """select o_orderkey, case when o_totalprice <= 20000 then 'missing' when o_orderstatus = 'P' then 'new' when o_totalprice > 200000 then 'changed' else 'same' end as "check" from orders where o_orderstatus <> 'P' or o_totalprice > 20000""",
}
