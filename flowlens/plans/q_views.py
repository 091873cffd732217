"""Queries behind dashboards, desks and reports; text in words; versions, changes and samples."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.functions import addresses as forms
from flowlens.functions import text as words
from flowlens.operators import flow, labels, views
from flowlens.plans import binding as b
from flowlens.plans import q_flow


def _cases(spark, sf_dir):
    """Orders as cases: id, chain, outcome, priority, opened, value."""
    o, c, n = (b.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    r = b.table(spark, sf_dir, "region")
    place = n.join(r, n.n_regionkey == r.r_regionkey)
    joined = o.join(c, o.o_custkey == c.c_custkey).join(place, c.c_nationkey == n.n_nationkey)
    return joined.select(
        F.col("o_orderkey").alias("case_id"), F.col("r_name").alias("chain"), F.col("n_name").alias("entity"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("opened"), b.cents(F.col("o_totalprice")).alias("value"), F.col("o_custkey").alias("suspect"), F.col("c_mktsegment").alias("segment"),
    )


def dashboard_counts(spark, sf_dir):
    """Counts along every dimension in one pass of grouping sets, with the median value."""
    sides = [F.col("status"), F.col("chain"), F.col("priority")]
    per = _cases(spark, sf_dir).groupingSets([[sides[0]], [sides[1]], [sides[2]], []], *sides)
    return per.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"), F.median("value").alias("median_value"))


def top_exchanges(spark, sf_dir):
    named = b.label_sources(spark, sf_dir).where(F.col("category").isin(labels.PROVIDERS))
    return named.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity").limit(8)


def desk_rows(spark, sf_dir):
    """One row an entity: cases, open ones, money, newest case, its suspects."""
    per = _cases(spark, sf_dir).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("status") == "O").alias("n_open"), F.sum("value").alias("value"),
        F.max_by("case_id", F.struct("opened", "case_id")).alias("newest"), F.count_distinct("suspect").alias("n_suspects"),
    )
    return per


def jurisdiction_rollup(spark, sf_dir):
    return _cases(spark, sf_dir).rollup("chain", "entity").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def write_order(spark, sf_dir):
    """Whom to write to first: by route, then share, then last case, then name."""
    per = _cases(spark, sf_dir).groupBy("chain", "entity").agg(F.sum("value").alias("value"), F.max("opened").alias("last"))
    route = F.when(F.col("chain") == "ASIA", "domestic").when(F.col("chain").isin("EUROPE", "AMERICA"), "direct").otherwise("offshore")
    rank = F.when(route == "domestic", 0).when(route == "direct", 1).otherwise(2)
    order = W.partitionBy().orderBy(rank, F.col("value").desc(), F.col("last").desc(), "entity")
    return per.orderBy(rank, F.col("value").desc(), F.col("last").desc(), "entity").limit(100).select("entity", route.alias("route"), "value", F.row_number().over(order).cast("long").alias("place"))


def follow_ups(spark, sf_dir):
    """Open cases by days left of a month, overdue ones first."""
    left = F.datediff(F.date_add(F.to_date("opened"), 30), F.lit("1998-08-01").cast("date")).cast("long")
    rows = _cases(spark, sf_dir).where("status = 'O'").select("case_id", left.alias("days_left"))
    return rows.where("days_left <= 7 and days_left >= -60").withColumn("state", F.when(F.col("days_left") < 0, "overdue").otherwise("due"))


def timeline(spark, sf_dir):
    e = b.table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    return views.timeline(e, "user_id")


def linked_complaints(spark, sf_dir):
    t = b.transfers(spark, sf_dir)
    reached = t.select(F.col("to_addr").alias("address"), F.substring_index("tx_hash", "-", 1).alias("case_id"), F.col("from_addr").alias("suspect"), F.col("block_time").alias("ts"), "amount")
    return views.linked_cases(reached, 400)


def _freezes(spark, sf_dir):
    e = b.table(spark, sf_dir, "events").where("event_type in ('signup', 'error')")
    return e.select(F.concat(F.lit("U"), "user_id").alias("address"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "signup").alias("added"))


def freeze_replay(spark, sf_dir):
    return views.replay(_freezes(spark, sf_dir))


def freeze_released(spark, sf_dir):
    return views.released(_freezes(spark, sf_dir))


def watch_changes(spark, sf_dir):
    e = b.wallet_events(spark, sf_dir)
    return views.changes(e.where("ts < timestamp_ntz'2024-01-08'"), e.where("ts >= timestamp_ntz'2024-01-08'"), ["wallet", "far"])


def page_diff(spark, sf_dir):
    p = b.table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("digest"))
    now = p.where("page_id % 7 <> 0").withColumn("digest", F.when(F.col("page_id") % 5 == 0, F.reverse("digest")).otherwise(F.col("digest")))
    return views.diff(p.where("page_id % 6 <> 0"), now, "page_id", "digest")


def round_robin_sample(spark, sf_dir):
    t = b.transfers(spark, sf_dir)
    return views.round_robin(t, "to_addr", [F.md5(F.concat("tx_hash", "from_addr").cast("binary")), F.col("amount")], 250).select("to_addr", "from_addr", "tx_hash", F.col("depth").cast("long").alias("depth"))


def latest_versions(spark, sf_dir):
    """The newest event of every user and kind: an append-only table read as an upserted one."""
    e = b.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return views.latest(e, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])


def gas_interval_join(spark, sf_dir):
    e = b.wallet_events(spark, sf_dir)
    sweeps = e.where("not is_in").select(F.col("wallet").alias("address"), F.col("event_id").alias("sweep_id"), F.col("ts").alias("sweep_ts"))
    pays = e.where("is_in").select(F.col("wallet").alias("address"), F.col("event_id").alias("pay_id"), F.col("ts").alias("pay_ts"), F.col("far").alias("payer"))
    return views.interval_join(sweeps, pays, 3600)


def gas_stations(spark, sf_dir):
    t = b.transfers(spark, sf_dir)
    served = t.join(b.labels(spark, sf_dir).select(F.col("address").alias("to_addr"), F.col("kind").alias("entity")), "to_addr")
    return views.stations(served.select(F.col("fee_payer").alias("payer"), F.col("from_addr").alias("address"), "entity"), 10, 0.35)


def audit_chain_check(spark, sf_dir):
    """Each user's events as a log; a row's digest covers its payload and the row before; some rows are tampered with."""
    e = b.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    payload = lambda kind: F.concat(F.col("event_id").cast("string"), kind)
    before = F.coalesce(F.lag(payload(F.col("event_type"))).over(W.partitionBy("user_id").orderBy("event_id")), F.lit(""))
    kept = e.withColumn("digest", F.sha2(F.concat(before, payload(F.col("event_type"))).cast("binary"), 256))
    tampered = kept.withColumn("event_type", F.when(F.col("event_id") % 97 == 0, "none").otherwise(F.col("event_type")))
    return views.chain_breaks(tampered, "user_id", "event_id", payload(F.col("event_type")), "digest")


def deposit_features(spark, sf_dir):
    e = b.wallet_events(spark, sf_dir)
    return views.deposit_features(e, flow.lifo_pairs(e))


def freeze_search(spark, sf_dir):
    """The second page of frozen addresses with a 1 in them."""
    frozen = views.replay(_freezes(spark, sf_dir)).withColumn("chain", F.when(F.substring("address", -1, 1).isin("0", "2", "4", "6", "8"), "eth").otherwise("tron"))
    return views.page(views.search_frozen(frozen, "1", "tron"), [F.col("chain"), F.col("address")], 20, 20)


def freeze_check_sample(spark, sf_dir):
    events = _freezes(spark, sf_dir)
    return views.check_sample(views.replay(events), views.released(events), 40, 7)


def case_page(spark, sf_dir):
    """Open cases without a name that touch a threat, the newest first."""
    key, by = F.col("case_id"), F.col("suspect")
    touched = F.filter(F.array(F.when(by % 23 == 3, "ransomware"), F.when(by % 29 == 5, "scam")), lambda x: x.isNotNull())
    cases = _cases(spark, sf_dir).select("case_id", "status", "opened", F.when(key % 3 == 0, "ATTRIBUTED").otherwise("INSUFFICIENT_EVIDENCE").alias("outcome"), touched.alias("threats"))
    found = views.page(views.filter_cases(cases, "INSUFFICIENT_EVIDENCE", "O", "any"), [F.col("opened").desc(), F.col("case_id")], 25, 25)
    return found.withColumn("threats", F.array_join("threats", ","))


def address_extract(spark, sf_dir):
    """Names with digits in them, found in the texts of documents, in order and each once."""
    d = b.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(words.addresses(F.col("text")), ",").alias("found")).where("found <> ''")


def amounts_in_words(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    share, price = (F.col("o_orderkey") % 1001) / 1000, b.cents(F.col("o_totalprice"))
    low, high = words.interval(share, F.lit(25.0))
    return o.select(
        "o_orderkey", words.percent(share).alias("share"), words.probability(share).alias("p"), words.duration(F.col("o_orderkey") * 37).alias("span"), words.indian_groups(price).alias("grouped"),
        words.short(F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256)).alias("id"), words.case_id(F.col("o_orderkey").cast("string")).alias("case"), low.alias("low"), high.alias("high"),
    )


def address_forms(spark, sf_dir):
    """Addresses made from keys, some with a broken checksum, by the form they are valid in."""
    raw = F.col("s_suppkey")
    made = b.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("0x"), F.substring(F.md5(raw.cast("string").cast("binary")), 1, 32), F.lit("00000000")).alias("address"))
    odd = made.withColumn("address", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("T"), F.substring("address", 3, 33))).otherwise(F.col("address")))
    return odd.select("s_suppkey", forms.detect_form(F.col("address")).alias("form"))


QUERIES = {
    f.__name__: f
    for f in (
        dashboard_counts, top_exchanges, desk_rows, jurisdiction_rollup, write_order, follow_ups, timeline, linked_complaints, freeze_replay, freeze_released, watch_changes, page_diff,
        round_robin_sample, latest_versions, gas_interval_join, gas_stations, audit_chain_check, deposit_features, freeze_search, freeze_check_sample, case_page, address_extract, amounts_in_words, address_forms,
    )
}

_CASES = """cases_rel as (select o_orderkey as case_id, r_name as chain, n_name as entity, o_orderstatus as status, o_orderpriority as priority, o_orderdate as opened,
        round(o_totalprice * 100)::bigint as value, o_custkey as suspect from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
_FREEZE = "f as (select 'U' || user_id as address, ts, event_id as seq, event_type = 'signup' as added from events where event_type in ('signup', 'error'))"
_NOW = "z as (select address, min(ts) as since from f where added and not exists (select 1 from f g where g.address = f.address and not g.added and row(g.ts, g.seq) > row(f.ts, f.seq)) group by address)"

ORACLES = {
    "dashboard_counts": f"with {_CASES} select status, chain, priority, count(*) as n, sum(value)::bigint as value, median(value)::double as median_value from cases_rel group by grouping sets ((status), (chain), (priority), ())",
    "top_exchanges": b.sql("label_sources", "select entity, count(*) as n from label_sources where category in ('exchange', 'swap') group by 1 order by n desc, entity limit 8"),
    "desk_rows": f"""with {_CASES} select entity, count(*) as n_cases, count(*) filter (status = 'O') as n_open, sum(value)::bigint as value, arg_max(case_id, row(opened, case_id)) as newest,
        count(distinct suspect) as n_suspects from cases_rel group by entity""",
    "jurisdiction_rollup": f"with {_CASES} select chain, entity, sum(value)::bigint as value, count(*) as n, grouping_id(chain, entity)::bigint as level from cases_rel group by rollup (chain, entity)",
    "write_order": f"""with {_CASES}, p as (select chain, entity, sum(value)::bigint as value, max(opened) as last from cases_rel group by all),
        r as (select *, case when chain = 'ASIA' then 'domestic' when chain in ('EUROPE', 'AMERICA') then 'direct' else 'offshore' end as route from p)
        select entity, route, value, row_number() over (order by case route when 'domestic' then 0 when 'direct' then 1 else 2 end, value desc, last desc, entity) as place from r qualify place <= 100""",
    "follow_ups": f"""with {_CASES}, d as (select case_id, date_diff('day', date '1998-08-01', opened::date + 30) as days_left from cases_rel where status = 'O')
        select case_id, days_left, case when days_left < 0 then 'overdue' else 'due' end as state from d where days_left between -60 and 7""",
    "deposit_features": b.sql("wallet_events", f"""{q_flow.LIFO},
        z as (select wallet, count(*) filter (is_in) as n_in, count(*) filter (not is_in) as n_out, sum(amount) filter (is_in) as got, count(distinct far) filter (is_in) as n_senders, count(distinct far) filter (not is_in) as n_recipients
            from wallet_events group by 1),
        tr as (select wallet, round(max(v) / nullif(sum(v), 0), 6) as top_recipient_share from (select wallet, far, sum(amount) as v from wallet_events where not is_in group by all) group by 1),
        us as (select wallet, sum(amount) as forwarded, median(wait_s)::double as dwell_median_s from lp group by 1),
        gp as (select wallet, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by wallet order by ts, event_id)) / 1000000 as gap from wallet_events where not is_in),
        cv as (select wallet, case when count(gap) >= 2 then round(stddev_pop(gap) / nullif(avg(gap), 0), 4) end as sweep_gap_cv from gp group by 1)
        select wallet, n_in, n_out, n_senders, n_recipients, round(n_out / greatest(n_in, 1), 6) as out_per_in, round(coalesce(forwarded, 0) / nullif(got, 0), 6) as forward_ratio,
               round(1 - round(coalesce(forwarded, 0) / nullif(got, 0), 6), 6) as left_share, top_recipient_share, dwell_median_s, sweep_gap_cv
        from z left join tr using (wallet) left join us using (wallet) left join cv using (wallet)"""),
    "timeline": """select user_id, ts, event_id as seq, event_type as kind, (epoch_us(ts) - lag(epoch_us(ts)) over w) // 1000000 as after_s, (epoch_us(ts) - first_value(epoch_us(ts)) over w) // 1000000 as since_first_s
        from events window w as (partition by user_id order by ts, event_id)""",
    "linked_complaints": b.sql("transfers", """select to_addr as address, count(distinct split_part(tx_hash, '-', 1)) as n_cases, count(distinct from_addr) as n_suspects, min(block_time) as first_ts, sum(amount)::bigint as amount
        from transfers group by 1 having count(distinct from_addr) >= 400"""),
    "freeze_replay": f"with {_FREEZE}, {_NOW} select * from z",
    "freeze_search": f"""with {_FREEZE}, {_NOW}, c as (select *, case when right(address, 1) in ('0', '2', '4', '6', '8') then 'eth' else 'tron' end as chain from z),
        w as (select count(*) over () as total, row_number() over (order by chain, address) as place, * from c where chain = 'tron' and contains(lower(address), '1')),
        e as (select count(*) as total from c where chain = 'tron' and contains(lower(address), '1')) select e.total, place, address, since, chain from e left join (select * from w where place between 21 and 40) on true""",
    "freeze_check_sample": f"""with {_FREEZE}, {_NOW}, g as (select distinct address from f where not added and address not in (select address from z))
        select * from (select address, true as expected from z order by md5('7-' || address), address limit 40) union all select * from (select address, false from g order by md5('7-' || address), address limit 40)""",
    "case_page": f"""with {_CASES}, k as (select case_id, status, opened, case when case_id % 3 = 0 then 'ATTRIBUTED' else 'INSUFFICIENT_EVIDENCE' end as outcome, concat_ws(',', case when suspect % 23 = 3 then 'ransomware' end, case when suspect % 29 = 5 then 'scam' end) as threats from cases_rel),
        w as (select count(*) over () as total, row_number() over (order by opened desc, case_id) as place, * from k where outcome = 'INSUFFICIENT_EVIDENCE' and status = 'O' and threats <> ''),
        e as (select count(*) as total from k where outcome = 'INSUFFICIENT_EVIDENCE' and status = 'O' and threats <> '') select e.total, w.* exclude (total) from e left join (select * from w where place between 26 and 50) w on true""",
    "freeze_released": f"with {_FREEZE}, {_NOW} select distinct address from f where not added and address not in (select address from z)",
    "watch_changes": b.sql("wallet_events", """with a as (select distinct wallet, far from wallet_events where ts < '2024-01-08'), n as (select distinct wallet, far from wallet_events where ts >= '2024-01-08')
        select *, 'new' as change from (from n except from a) union all select *, 'gone' from (from a except from n)"""),
    "page_diff": """with p as (select page_id, sha256(html) as d from pages), a as (select * from p where page_id % 6 <> 0),
        n as (select page_id, case when page_id % 5 = 0 then reverse(d) else d end as d from p where page_id % 7 <> 0)
        select page_id, case when n.d is null then 'gone' when a.d is null then 'added' when a.d = n.d then 'same' else 'changed' end as status from a full join n using (page_id)""",
    "round_robin_sample": b.sql("transfers", """select to_addr, from_addr, tx_hash, depth from (select *, row_number() over (partition by to_addr order by md5(tx_hash || from_addr), amount) as depth from transfers)
        order by depth, to_addr limit 250"""),
    "latest_versions": "select user_id, event_type, event_id, ts, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1",
    "gas_interval_join": b.sql("wallet_events", """select s.wallet as address, s.event_id as sweep_id, p.event_id as pay_id, p.far as payer from wallet_events s join wallet_events p on s.wallet = p.wallet
        and not s.is_in and p.is_in and p.ts <= s.ts and p.ts >= s.ts - interval 1 hour"""),
    "gas_stations": b.sql("transfers labels", """with s as (select fee_payer as payer, kind as entity, count(distinct from_addr) as n from transfers join labels_rel on to_addr = address group by all),
        q as (select payer, arg_max(entity, row(n, entity)) as entity, max(n) as most, sum(n)::bigint as n_addresses from s group by payer) select payer, entity, n_addresses from q where n_addresses >= 10 and most >= 0.35 * n_addresses"""),
    # a digest covers the row before, so a changed row breaks its own check and that of the next one
    "audit_chain_check": """with e as (select user_id, event_id, event_type, lag(event_id) over (partition by user_id order by event_id) as prev from events)
        select user_id, event_id from e where (event_id % 97 = 0 and event_type <> 'none') or coalesce(prev % 97 = 0, false)""",
    "address_extract": r"""with f as (select doc_id, regexp_extract_all(text, '\b[A-Za-z]+[0-9][A-Za-z0-9]{6,}\b') as a from documents),
        g as (select doc_id, list_filter(a, lambda x, i: list_position(a, x) = i) as u from f) select doc_id, array_to_string(u, ',') as found from g where len(u) > 0""",
}
