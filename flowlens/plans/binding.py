"""The engine's relations over the star-schema tables, and the same relations as SQL.

Money is in whole cents (BIGINT); wallets are `W<id>`, and customers and suppliers share the ids, so that receivers
send on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.labels import CATEGORY_RANK, TIER_RANK, dedupe

ASSETS = {"A": "USDT", "N": "USDC", "R": "COIN"}
STABLE = ["USDT", "USDC"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(value) -> F.Column:
    return F.round(value * 100).cast("long")


def transfers(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """tx_hash, block_time, from_addr, to_addr, asset, amount, amount_usd, fee_payer, and more columns of the tables."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    asset = F.when(F.col("l_returnflag") == "A", "USDT").when(F.col("l_returnflag") == "N", "USDC").otherwise("COIN")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    rows = joined.select(
        F.concat(F.lit("T"), "l_orderkey", F.lit("-"), "l_linenumber", F.lit("-"), "l_partkey").alias("tx_hash"),
        F.col("l_shipdate").alias("block_time"),
        F.concat(F.lit("W"), "o_custkey").alias("from_addr"),
        F.concat(F.lit("W"), "l_suppkey").alias("to_addr"),
        asset.alias("asset"),
        cents(F.col("l_extendedprice")).alias("amount"),
        F.concat(F.lit("W"), F.col("l_partkey") % 100).alias("fee_payer"),
        *more,
    )
    return rows.withColumn("amount_usd", F.when(F.col("asset").isin(STABLE), F.col("amount")))


def utxo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txid, ts, inputs (array of addresses), outputs (array of address, amount), fee: one row an order."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    # lines of an order are apart in the table, so lists begun where they are would only be larger rows
    lines = lines.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", cents(F.col("l_extendedprice")).alias("amount"), cents(F.col("l_extendedprice") * F.col("l_tax")).alias("fee"))
    out = F.struct("l_linenumber", "l_suppkey", "l_partkey", "amount")
    grouped = lines.repartition("l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(out)).alias("out"), F.sum("fee").alias("fee"))
    inputs = F.sort_array(F.array_distinct(F.array_compact(F.transform("out", lambda x: F.concat(F.lit("A"), x.l_partkey)))))
    outputs = F.transform("out", lambda x: F.struct(F.concat(F.lit("B"), x.l_suppkey).alias("address"), x.amount.alias("amount")))
    joined = grouped.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.concat(F.lit("X"), "o_orderkey").alias("txid"), F.col("o_orderdate").alias("ts"), inputs.alias("inputs"), outputs.alias("outputs"), "fee")


CATEGORIES = ["exchange", "swap", "sanctioned", "mixer", "bridge", "defi", "unknown"]
TIERS = ["published_por", "curated", "explorer_tag", "derived"]
KINDS = ["hot", "deposit", "cold"]


def _pick(values: list[str], at) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def label_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """address, chain, entity, category, tier, kind, source, confidence: up to three sources name an address."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    base = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    key = F.col("s_suppkey")
    first = base.select(
        F.concat(F.lit("W"), key).alias("address"), F.col("r_name").alias("chain"), F.col("n_name").alias("entity"),
        _pick(CATEGORIES, key % 7).alias("category"), _pick(TIERS, key % 4).alias("tier"), _pick(KINDS, key % 3).alias("kind"),
        F.lit("registry").alias("source"), (F.lit(50) + key % 50).cast("long").alias("confidence"), key.alias("key"),
    )
    second = first.where("key % 2 = 0").select(
        "address", "chain", "entity", _pick(CATEGORIES, (F.col("key") + 1) % 7).alias("category"), _pick(TIERS, (F.col("key") + 2) % 4).alias("tier"),
        "kind", F.lit("crowd").alias("source"), (F.lit(40) + F.col("key") % 30).cast("long").alias("confidence"), "key",
    )
    third = first.where("key % 5 = 0").select(
        "address", "chain", F.concat("entity", F.lit(" 2")).alias("entity"), "category", F.lit("derived").alias("tier"), F.lit("deposit").alias("kind"),
        F.lit("model").alias("source"), F.lit(70).cast("long").alias("confidence"), "key",
    )
    return first.unionByName(second).unionByName(third).drop("key")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label an address: what remains of label_sources."""
    return dedupe(label_sources(spark, sf_dir)).drop("chain")


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txid, ts, src_ip, src_asn, src_port, dst_port, is_tor, is_vpn: who announced a transaction."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("X"), F.expr("event_id div 3")).alias("txid"), F.col("event_id").alias("row_id"), "ts",
        F.concat(F.lit("ip"), "user_id").alias("src_ip"), (F.col("user_id") % 7).cast("long").alias("src_asn"),
        (F.lit(1024) + (F.col("event_id") * 7919) % 64000).cast("long").alias("src_port"),
        F.when(F.col("event_id") % 5 == 0, 8334).otherwise(8333).cast("long").alias("dst_port"),
        (F.col("event_type") == "error").alias("is_tor"), (F.col("event_type") == "view").alias("is_vpn"),
    )


def wallet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wallet, event_id, ts, is_in, amount, far: purchases and signups arrive, all else leaves."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("U"), "user_id").alias("wallet"), "event_id", "ts", F.col("event_type").isin("purchase", "signup").alias("is_in"),
        cents(F.coalesce("value", F.lit(0.0))).alias("amount"), F.concat(F.lit("C"), F.col("event_id") % 10).alias("far"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, y, toxic, score, grp, amount: labelled documents as scored examples."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return l.join(d.select("doc_id", "n_chars", "source"), "doc_id").select(
        F.col("doc_id").alias("idx"), F.col("quality").cast("long").alias("y"), F.col("toxic").cast("long").alias("toxic"),
        ((F.col("n_chars") % 1000) / 1000).alias("score"), F.col("source").alias("grp"), F.col("n_chars").alias("amount"),
    )


def _sql_pick(values: list[str], at: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({at}) % {len(values)} + 1]"


def _sql_rank(ranks: dict[str, int], column: str) -> str:
    return "case " + column + "".join(f" when '{k}' then {v}" for k, v in ranks.items()) + " else 0 end"


SQL = {
    "transfers": """
        select 'T' || l_orderkey || '-' || l_linenumber || '-' || l_partkey as tx_hash, l_shipdate as block_time, 'W' || o_custkey as from_addr,
               'W' || l_suppkey as to_addr, case l_returnflag when 'A' then 'USDT' when 'N' then 'USDC' else 'COIN' end as asset,
               round(l_extendedprice * 100)::bigint as amount, case when l_returnflag in ('A', 'N') then round(l_extendedprice * 100)::bigint end as amount_usd,
               'W' || (l_partkey % 100) as fee_payer
        from lineitem join orders on l_orderkey = o_orderkey""",
    "utxo": """
        select 'X' || o_orderkey as txid, o_orderdate as ts, inputs, addresses, amounts, fee from orders join (
            select l_orderkey, list(distinct 'A' || l_partkey order by 'A' || l_partkey) as inputs,
                   list('B' || l_suppkey order by l_linenumber, l_suppkey, l_partkey, l_extendedprice) as addresses,
                   list(round(l_extendedprice * 100)::bigint order by l_linenumber, l_suppkey, l_partkey, l_extendedprice) as amounts,
                   sum(round(l_extendedprice * l_tax * 100)::bigint)::bigint as fee
            from lineitem group by l_orderkey) on l_orderkey = o_orderkey""",
    "label_sources": f"""
        with b as (select s_suppkey as key, 'W' || s_suppkey as address, r_name as chain, n_name as entity from supplier
                   join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
        select address, chain, entity, {_sql_pick(CATEGORIES, "key")} as category, {_sql_pick(TIERS, "key")} as tier, {_sql_pick(KINDS, "key")} as kind,
               'registry' as source, (50 + key % 50)::bigint as confidence from b
        union all select address, chain, entity, {_sql_pick(CATEGORIES, "key + 1")}, {_sql_pick(TIERS, "key + 2")}, {_sql_pick(KINDS, "key")}, 'crowd', (40 + key % 30)::bigint
            from b where key % 2 = 0
        union all select address, chain, entity || ' 2', {_sql_pick(CATEGORIES, "key")}, 'derived', 'deposit', 'model', 70::bigint from b where key % 5 = 0""",
    "labels": f"""
        select address, entity, category, tier, kind, source, confidence from (
            select *, row_number() over (partition by address, chain order by {_sql_rank(TIER_RANK, "tier")} desc, {_sql_rank(CATEGORY_RANK, "category")} desc,
                                         source, confidence desc, entity) as n from label_sources) where n = 1""",
    "announcements": """
        select 'X' || (event_id // 3) as txid, event_id as row_id, ts, 'ip' || user_id as src_ip, (user_id % 7)::bigint as src_asn,
               (1024 + (event_id * 7919) % 64000)::bigint as src_port, (case when event_id % 5 = 0 then 8334 else 8333 end)::bigint as dst_port,
               event_type = 'error' as is_tor, event_type = 'view' as is_vpn from events""",
    "wallet_events": """
        select 'U' || user_id as wallet, event_id, ts, event_type in ('purchase', 'signup') as is_in, round(coalesce(value, 0) * 100)::bigint as amount,
               'C' || (event_id % 10) as far from events""",
    "scored": """
        select doc_id as idx, quality::bigint as y, toxic::bigint as toxic, (n_chars % 1000) / 1000 as score, source as grp, n_chars as amount
        from labels join documents using (doc_id)""",
}


def sql(relations: str, body: str) -> str:
    """A query over some of the relations."""
    need = relations.split()
    if "labels" in need and "label_sources" not in need:
        need.insert(need.index("labels"), "label_sources")
    named = [f"{'labels_rel' if n == 'labels' else n} as ({SQL[n]})" for n in need]
    return ("with recursive " + ", ".join(named) + "," + body.split("with", 1)[1]) if body.lstrip().startswith("with ") else "with " + ", ".join(named) + " " + body
