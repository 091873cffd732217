"""Queries on payment graphs and behavioural features."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import edges, features
from flowlens.plans import binding as b

_EDGES = """select from_addr as src, to_addr as dst, count(*) as n_tx, sum(amount)::bigint as value, min(block_time) as first_ts, max(block_time) as last_ts
            from transfers where from_addr <> to_addr group by all"""


def entity_edges(spark, sf_dir):
    return edges.entity_edges(b.transfers(spark, sf_dir))


def active_entities(spark, sf_dir):
    return edges.active_entities(entity_edges(spark, sf_dir), 30)


def member_stats(spark, sf_dir):
    members = b.labels(spark, sf_dir).select("address")
    return edges.member_stats(b.transfers(spark, sf_dir), members)


def counterparty_hhi(spark, sf_dir):
    """Concentration of every wallet's counterparties, with the label of the wallet."""
    found = edges.counterparties(entity_edges(spark, sf_dir))
    named = b.labels(spark, sf_dir).select(F.col("address").alias("entity"), F.col("entity").alias("label"))
    return found.join(named, "entity", "left")


def tx_features(spark, sf_dir):
    return features.transaction_features(b.utxo(spark, sf_dir))


def _owners(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("X"), "o_orderkey").alias("txid"), F.concat(F.lit("E"), "o_custkey").alias("entity"))


def amount_features(spark, sf_dir):
    return features.amount_features(features.transaction_features(b.utxo(spark, sf_dir), digits=None), _owners(spark, sf_dir))


def tx_head_matrix(spark, sf_dir):
    return features.transaction_head(tx_features(spark, sf_dir), _owners(spark, sf_dir))


def _scripts(spark, sf_dir):
    p = b.table(spark, sf_dir, "part")
    prefix = F.element_at(F.array(*map(F.lit, ["bc1p", "bc1qshort", "bc1q" + "x" * 50, "1", "3", "?"])), (F.col("p_size") % 6 + 1).cast("int"))
    return p.select("p_partkey", F.col("p_brand").alias("entity"), F.concat(prefix, "p_partkey").alias("address"))


def script_type(spark, sf_dir):
    return _scripts(spark, sf_dir).select("p_partkey", features.script_type(F.col("address")).alias("script"))


def script_features(spark, sf_dir):
    rows = _scripts(spark, sf_dir).withColumn("script", features.script_type(F.col("address")))
    change = F.when(F.col("p_partkey") % 3 == 0, F.col("script")).when(F.col("p_partkey") % 3 == 1, "p2pkh")
    return features.script_features(rows.withColumn("change_script", change))


def _moves(spark, sf_dir):
    return b.wallet_events(spark, sf_dir).select(F.col("wallet").alias("entity"), "ts", F.col("event_id").alias("row_id"), "amount")


def temporal_gaps(spark, sf_dir):
    return features.temporal_gaps(_moves(spark, sf_dir))


def hourly_features(spark, sf_dir):
    return features.hourly_features(_moves(spark, sf_dir))


def censoring_rates(spark, sf_dir):
    return features.censoring_features(_moves(spark, sf_dir))


def _announced_owners(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    return e.groupBy(F.concat(F.lit("X"), F.expr("event_id div 3")).alias("txid")).agg(F.concat(F.lit("E"), F.min("user_id") % 20).alias("entity"))


def network_features(spark, sf_dir):
    return features.network_features(b.announcements(spark, sf_dir), _announced_owners(spark, sf_dir))


def entity_ip_counts(spark, sf_dir):
    return features.entity_ip_counts(b.announcements(spark, sf_dir), _announced_owners(spark, sf_dir))


def collapse_announcements(spark, sf_dir):
    return features.collapse_announcements(b.announcements(spark, sf_dir))


def attach_entities(spark, sf_dir):
    s, p = b.table(spark, sf_dir, "supplier"), b.table(spark, sf_dir, "part")
    owners = s.select(F.concat(F.lit("B"), "s_suppkey").alias("address"), F.concat(F.lit("N"), "s_nationkey").alias("entity"))
    owners = owners.unionByName(p.where("p_partkey % 2 = 0").select(F.concat(F.lit("A"), "p_partkey").alias("address"), F.col("p_brand").alias("entity")))
    return features.attach_entities(b.utxo(spark, sf_dir), owners)


QUERIES = {
    f.__name__: f
    for f in (
        entity_edges, active_entities, member_stats, counterparty_hhi, tx_features, amount_features, tx_head_matrix, script_type, script_features,
        temporal_gaps, hourly_features, censoring_rates, network_features, entity_ip_counts, collapse_announcements, attach_entities,
    )
}

_TX_RAW = """t as (select txid, ts, list_sum(amounts)::bigint as value_out, len(amounts)::bigint as n_outputs, len(inputs)::bigint as n_inputs, amounts, fee from utxo),
    tx as (select txid, value_out, n_outputs, n_inputs,
        case when value_out > 0 then ROUND(list_sum(list_transform(amounts, lambda x: -(x / value_out) * ln(greatest(x / value_out, 1e-12)))) / ln(greatest(n_outputs, 2)), DIGITS) else 0 end as output_entropy,
        ROUND(1 - len(list_distinct(amounts)) / greatest(n_outputs, 1), DIGITS) as output_uniformity, list_min(amounts) as min_out, list_max(amounts) as max_out,
        case when n_outputs = 2 then ROUND(list_min(amounts) / greatest(value_out, 1), DIGITS) end as peel_ratio,
        ROUND(fee / greatest(value_out, 1), DIGITS) as fee_ratio, ROUND(fee / greatest(11 + 68 * n_inputs + 31 * n_outputs, 1), DIGITS) as feerate_sat_vb,
        ROUND(len(list_filter(amounts, lambda x: x % 1000000 = 0)) / greatest(n_outputs, 1), DIGITS) as round_frac,
        ROUND(len(list_filter(amounts, lambda x: x % 100000000 > 80000000)) / greatest(n_outputs, 1), DIGITS) as structuring_frac,
        hour(ts) as hour_utc, isodow(ts) as weekday from t)"""
_TX = _TX_RAW.replace("ROUND(", "round(").replace(", DIGITS)", ", 6)")
_TX_RAW = _TX_RAW.replace("ROUND(", "(").replace(", DIGITS)", ")")
_OWNERS = "o as (select 'X' || o_orderkey as txid, 'E' || o_custkey as entity, o_custkey from orders)"
_SCRIPTS = """s as (select p_partkey, p_brand as entity, ['bc1p', 'bc1qshort', 'bc1q' || repeat('x', 50), '1', '3', '?'][p_size % 6 + 1] || p_partkey as address from part),
    t as (select *, case when address like 'bc1p%' then 'p2tr' when address like 'bc1q%' and length(address) <= 45 then 'p2wpkh' when address like 'bc1q%' then 'p2wsh'
                         when address like '1%' then 'p2pkh' when address like '3%' then 'p2sh' else 'unknown' end as script from s)"""
_ANN = "o as (select 'X' || (event_id // 3) as txid, 'E' || (min(user_id) % 20) as entity from events group by 1)"

ORACLES = {
    "entity_edges": b.sql("transfers", _EDGES),
    "active_entities": b.sql("transfers", f"""with e as ({_EDGES}), o as (select src, count(*) as n from e group by 1), i as (select dst, count(*) as n from e group by 1)
        select coalesce(src, dst) as entity, coalesce(o.n, 0) as n_out, coalesce(i.n, 0) as n_in from o full join i on src = dst where coalesce(o.n, 0) + coalesce(i.n, 0) >= 30"""),
    "member_stats": b.sql("transfers labels", """with m as (select address from labels_rel),
        t as (select * from transfers where from_addr <> to_addr and from_addr in (select address from m) and to_addr in (select address from m)),
        o as (select from_addr as address, count(*) as n, sum(amount) as v from t group by 1), i as (select to_addr as address, count(*) as n, sum(amount) as v from t group by 1)
        select m.address, coalesce(o.n, 0) as n_sent, coalesce(i.n, 0) as n_got, coalesce(o.v, 0)::bigint as sent, coalesce(i.v, 0)::bigint as got from m left join o using (address) left join i using (address)"""),
    "counterparty_hhi": b.sql("transfers labels", f"""with e as ({_EDGES}),
        o as (select src, count(*) as n, round(sum(value::hugeint * value)::double / sum(value)::double / sum(value)::double, 6) as hhi from e group by 1),
        i as (select dst, count(*) as n, sum(value)::bigint as v from e group by 1),
        c as (select coalesce(src, dst) as entity, coalesce(o.n, 0) as n_counterparties_out, hhi as counterparty_hhi, coalesce(i.n, 0) as n_counterparties_in, coalesce(v, 0) as total_in
              from o full join i on src = dst)
        select c.*, l.entity as label from c left join labels_rel l on c.entity = l.address"""),
    "tx_features": b.sql("utxo", f"with {_TX} select * from tx"),
    "amount_features": b.sql("utxo", f"""with {_TX_RAW}, {_OWNERS}
        select entity, sum(value_out)::bigint as total_out, round(avg(value_out), 6) as mean_value_out, round(stddev_samp(value_out), 4) as std_value_out,
               round(avg(output_entropy), 6) as output_entropy_mean, round(min(output_entropy), 6) as output_entropy_min, round(max(output_uniformity), 6) as output_uniformity_max,
               round(avg(output_uniformity), 6) as output_uniformity_mean, round(avg(peel_ratio), 6) as peel_ratio_mean, round(avg((n_outputs = 2)::int), 6) as two_output_frac,
               round(avg(fee_ratio), 6) as fee_ratio_mean, round(avg(feerate_sat_vb), 6) as mean_feerate_sat_vb, round(avg(round_frac), 6) as round_number_frac,
               round(avg(structuring_frac), 6) as structuring_proximity, round(avg(n_outputs), 6) as mean_n_outputs, max(n_outputs) as max_n_outputs,
               round(avg(n_inputs), 6) as mean_n_inputs, max(n_inputs) as max_n_inputs from tx join o using (txid) group by entity"""),
    "tx_head_matrix": b.sql("utxo", f"""with {_TX}, {_OWNERS}, j as (select tx.*, entity from tx left join o using (txid))
        select txid, value_out, n_inputs, n_outputs, fee_ratio, case when entity is null then 0 else count(*) over (partition by entity) end as parent_n_tx,
               case when entity is null then 0 else round(value_out / greatest(sum(value_out) over (partition by entity), 1), 6) end as value_share_of_entity,
               round(n_inputs / greatest(n_outputs, 1), 6) as in_out_ratio_tx from j"""),
    "script_type": f"with {_SCRIPTS} select p_partkey, script from t",
    "script_features": f"""with {_SCRIPTS}, u as (select *, case p_partkey % 3 when 0 then script when 1 then 'p2pkh' end as change_script from t),
        n as (select entity, script, count(*) as n from u group by all)
        select entity, count(distinct script) as script_diversity, round((select max(n.n) from n where n.entity = u.entity) / count(*), 6) as script_uniformity,
               round(avg((script = 'p2tr')::int), 6) as taproot_frac, round(avg((script in ('p2tr', 'p2wpkh', 'p2wsh'))::int), 6) as segwit_frac,
               round(avg((script = change_script)::int), 6) as change_script_match_rate from u group by entity""",
    "temporal_gaps": b.sql("wallet_events", """with g as (select wallet as entity, ts, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by wallet order by ts, event_id)) // 1000000 as gap from wallet_events),
        p as (select entity, min(ts) as first_ts, max(ts) as last_ts, count(*) as n_tx_sent, round(avg(gap), 4) as gap_mean, round(stddev_samp(gap), 4) as gap_std, max(gap) as gap_max,
                     median(gap)::double as gap_median, round(avg((isodow(ts) >= 6)::int), 6) as weekend_ratio, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 as span from g group by entity)
        select * exclude (span), round(span / 86400, 6) as lifespan_days, round((gap_std - gap_mean) / greatest(gap_std + gap_mean, 1), 4) + 0 as burstiness,
               round(gap_max / greatest(span, 1), 6) as dormancy_ratio from p"""),
    "hourly_features": b.sql("wallet_events", """with h as (select wallet as entity, hour(ts) as hour, count(*) as n, sum(amount)::bigint as v from wallet_events group by all),
        r as (select *, sum(n) over w as all_n, sum(v) over w as all_v, row_number() over (partition by entity order by v, hour) as i, count(*) over w as k from h window w as (partition by entity))
        select entity, round(sum(-(n / all_n) * ln(n / all_n)) / ln(24), 6) as hour_entropy, max(n) as peak_hour_tx, round(max(v) / nullif(max(all_v), 0), 6) as peak_hour_value_frac,
               case when max(all_v) > 0 then round(2 * sum(i * v) / (max(k) * max(all_v)) - (max(k) + 1) / max(k), 6) else 0 end as hourly_value_gini from r group by entity"""),
    "censoring_rates": b.sql("wallet_events", """with e as (select epoch_us(min(ts)) / 1000000 as s, epoch_us(max(ts)) / 1000000 as e from wallet_events),
        p as (select wallet as entity, epoch_us(min(ts)) / 1000000 as f, epoch_us(max(ts)) / 1000000 as l, count(*) as n, sum(amount) as v from wallet_events group by 1)
        select entity, round((e - f) / 86400 / greatest((e - s) / 86400, 1e-9), 6) as window_coverage, round(n / greatest((e - f) / 86400, 1), 6) as tx_per_available_day,
               round(v / greatest((e - f) / 86400, 1), 4) as value_per_available_day, e - l < 86400 as right_censored,
               round((l - f) / 86400 / greatest((e - s) / 86400, 1e-9), 6) as span_fraction_of_capture from p, e"""),
    "network_features": b.sql("announcements", f"""with {_ANN}, a as (
        select entity, count(distinct src_ip) as n_ips, count(*) as n_announcements, count(distinct txid) as n_tx_observed, count(distinct src_asn) as n_asns,
               round(avg(is_tor::int), 6) as tor_frac, round(avg(is_vpn::int), 6) as vpn_frac, round(avg((src_port = 8333)::int), 6) as listening_node_ratio,
               round(avg((src_port between 32768 and 60999)::int), 6) as ephemeral_linux_frac, round(avg((src_port >= 49152)::int), 6) as ephemeral_windows_frac,
               count(distinct src_port) as n_src_ports, round(avg((dst_port <> 8333)::int), 6) as nonstandard_dst_port_frac from announcements join o using (txid) group by entity)
        select *, round(n_announcements / greatest(n_tx_observed, 1), 6) as announcements_per_tx, round(n_ips / greatest(n_tx_observed, 1), 6) as ip_churn_rate from a"""),
    "entity_ip_counts": b.sql("announcements", f"with {_ANN} select entity, src_ip, count(*) as n from announcements join o using (txid) group by all"),
    "collapse_announcements": b.sql("announcements", """select txid, min(ts) as ts, arg_min(src_ip, row(ts, row_id)) as first_ip, arg_min(src_port, row(ts, row_id)) as first_port,
        count(*) as n_seen, count(distinct src_ip) as n_ips, count(distinct src_asn) as n_asns from announcements group by txid"""),
    "attach_entities": b.sql("utxo", """with o as (select 'B' || s_suppkey as address, 'N' || s_nationkey as entity from supplier
            union all select 'A' || p_partkey, p_brand from part where p_partkey % 2 = 0),
        r as (select txid, string_agg(distinct entity, ',' order by entity) as e from (select txid, unnest(addresses) as address from utxo) join o using (address) group by txid)
        select u.txid, entity as sender_entity, coalesce(e, '') as receiver_entities from (select txid, inputs[1] as address from utxo) u left join o using (address) left join r on r.txid = u.txid"""),
}
