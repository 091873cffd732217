"""More queries: flags of traces, blind spots, stored cases, betweenness, reasons, session streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import edges, evaluation, flow, graph, ml, typologies, views
from flowlens.plans import binding as b
from flowlens.plans import q_flow, q_learn
from flowlens.session import cut
from flowlens.streaming import state


def typology_flags(spark, sf_dir):
    return typologies.flags(q_flow.kept_edges(q_flow.traced(spark, sf_dir)[0]), q_flow.trace_labels(spark, sf_dir))


def why_not_followed(spark, sf_dir):
    """Each wallet's weightiest reason not to be followed, counted."""
    holds = q_flow.traced(spark, sf_dir)[1].where("reason <> 'kept'")
    rank = F.array_position(F.array(*map(F.lit, ["labelled", "origin", "depth_limit", "small", "budget", "hub"])), F.col("reason"))
    best = holds.groupBy("origin", "wallet").agg(F.min_by("reason", rank).alias("reason"), F.sum("held").alias("held"))
    return best.groupBy("origin", "reason").agg(F.count(F.lit(1)).alias("n_wallets"), F.sum("held").alias("held"))


def blind_spots(spark, sf_dir):
    """What more is held, by reason, when the nearest service's label is hidden."""
    read = q_flow.given(spark, sf_dir)
    first, holds, _ = q_flow.traced(spark, sf_dir, read=read)
    top = cut(flow.candidates(first, read[1]).where("rank = 1").select("origin", "entity"))
    again = q_flow.traced(spark, sf_dir, hidden=top, read=read)[1]
    per = lambda h, name: h.groupBy("origin", "reason").agg(F.sum("held").alias(name))
    both = per(holds, "before").join(per(again, "after"), ["origin", "reason"], "full").na.fill(0, ["before", "after"])
    return both.where(F.col("after") > F.col("before")).join(top.select("origin"), "origin", "left_semi")


def case_heads(spark, sf_dir):
    """The newest event of each user, with a field of its JSON: a case store's heads."""
    newest = views.latest(b.table(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    return newest.select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


def betweenness(spark, sf_dir):
    e = cut(edges.entity_edges(b.transfers(spark, sf_dir)))
    return graph.betweenness(e, cut(graph.pivots_of(e)))


def gbt_reasons(spark, sf_dir):
    rows = q_learn._wallets(spark, sf_dir)
    return ml.reasons(ml.fit_trees(rows, q_learn.FEATURES), rows, q_learn.FEATURES, "wallet")


def stream_sessions(spark, sf_dir):
    """Runs of a user's events without a gap of six hours."""
    stream = q_learn._stream(spark, sf_dir, [F.col("ts").cast("timestamp").alias("ts"), "user_id"])
    rows = q_learn._drained(state.sessions(stream, "6 hours"), "complete", "sessions")
    last = views.latest(rows, ["user_id", "start"], [F.col("batch").desc()])
    return last.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def stream_sliding(spark, sf_dir):
    stream = q_learn._stream(spark, sf_dir, [F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type"])
    rows = q_learn._drained(state.sliding(stream), "update", "sliding")
    return views.latest(rows, ["user_id", "start"], [F.col("batch").desc()]).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def _wallet_columns(spark, sf_dir):
    edges = q_flow.traced(spark, sf_dir)[0]
    return edges.groupBy("origin", F.col("hop").cast("long").alias("hop"), F.col("to_addr").alias("wallet")).agg(F.sum("traced").alias("amount"))


def fold_graph(spark, sf_dir):
    return evaluation.fold(_wallet_columns(spark, sf_dir), 4)


def replay_steps(spark, sf_dir):
    return evaluation.replay_steps(q_flow.traced(spark, sf_dir)[0])


def timeline_days(spark, sf_dir):
    return evaluation.days(b.wallet_events(spark, sf_dir), "wallet").withColumn("day", F.col("day").cast("string"))


def nearest_with_queued(spark, sf_dir):
    ranked = cut(q_flow.candidates(spark, sf_dir).select("origin", "entity", "rank"))
    queued = ranked.where("rank % 3 = 0").select("origin", "entity")
    return evaluation.with_queued(ranked, queued, 1)


QUERIES = {f.__name__: f for f in (typology_flags, why_not_followed, blind_spots, case_heads, betweenness, gbt_reasons, stream_sessions, stream_sliding, fold_graph, replay_steps, timeline_days, nearest_with_queued)}

ORACLES = {
    "typology_flags": b.sql("transfers labels", f"""{q_flow._ALL}, p as (select origin, to_addr as wallet, sum(traced)::bigint as amount, min(hop)::bigint as hops, count(distinct tx_hash) as n_tx, count(distinct from_addr) as senders from e group by all),
        f as (select p.*, category as code from p join l on wallet = address where category in ('sanctioned', 'mixer', 'bridge') union all select p.*, 'fan_in' from p where senders >= 3)
        select origin, code, case code when 'bridge' then 'medium' when 'fan_in' then 'low' else 'high' end as severity, wallet, amount, round(amount / total, 6) as share, hops, n_tx from f join t using (origin)"""),
    "why_not_followed": b.sql("transfers labels", f"""{q_flow._ALL}, w as (select origin, wallet, arg_min(reason, list_position(['labelled', 'origin', 'depth_limit', 'small', 'budget', 'hub'], reason)) as reason, sum(held) as held
            from h where reason <> 'kept' group by origin, wallet) select origin, reason, count(*) as n_wallets, sum(held)::bigint as held from w group by all"""),
    "blind_spots": b.sql("transfers labels", f"""{q_flow._ALL}, {q_flow._CAND}, top as (select origin, entity from cc where rank = 1), {q_flow._trace(hidden="top", p="q")},
        x as (select origin, reason, sum(held)::bigint as v from h group by all), y as (select origin, reason, sum(held)::bigint as v from qh group by all)
        select coalesce(x.origin, y.origin) as origin, coalesce(x.reason, y.reason) as reason, coalesce(x.v, 0) as before, coalesce(y.v, 0) as after from x full join y on x.origin = y.origin and x.reason = y.reason
        where coalesce(y.v, 0) > coalesce(x.v, 0) and coalesce(x.origin, y.origin) in (select origin from top)"""),
    "case_heads": """select user_id, event_id, event_type, json_extract_string(props, '$.k')::bigint as k from events
        qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
    "fold_graph": b.sql("transfers labels", f"""{q_flow._ALL}, w as (select origin, hop::bigint as hop, to_addr as wallet, sum(traced) as amount from e group by all),
        k as (select *, row_number() over (partition by origin, hop order by amount desc, wallet) as i from w)
        select origin, hop, case when i <= 4 then wallet else 'more' end as wallet, sum(amount)::bigint as amount, count(*) as n from k group by all"""),
    "replay_steps": b.sql("transfers labels", f"""{q_flow._ALL}, aw as (select origin, from_addr, to_addr, min(block_time) as first_time, sum(traced)::bigint as traced from e group by all)
        select origin, row_number() over (partition by origin order by first_time, from_addr, to_addr) as step, from_addr, to_addr, first_time, traced from aw"""),
    "timeline_days": b.sql("wallet_events", """with s as (select *, case when not is_in then epoch_us(ts) - last_value(case when is_in then epoch_us(ts) end ignore nulls)
            over (partition by wallet order by ts, event_id rows between unbounded preceding and 1 preceding) end as since from wallet_events),
        d as (select wallet, ts::date as day, count(*) as n, count(*) filter (is_in) as n_in, floor(first(since order by ts, event_id) filter (not is_in) / 1000000)::bigint as arrived_s from s group by all)
        select * replace (day::varchar as day), date_diff('day', lag(day) over (partition by wallet order by day), day) as gap_days from d"""),
    "nearest_with_queued": b.sql("transfers labels", f"{q_flow._ALL}, {q_flow._CAND} select origin, entity, rank from cc where rank <= 1 or rank % 3 = 0"),
    "stream_sessions": """with g as (select user_id, ts, event_id, coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 6 hour, true) as new from events),
        s as (select *, sum(new::int) over (partition by user_id order by ts, event_id) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k""",
    "stream_sliding": """with w as (select user_id, time_bucket(interval 6 hour, ts) - to_hours(6 * k) as start from events, (select unnest([0, 1, 2, 3]) as k)) select user_id, start, count(*) as n from w group by all""",
}
