"""Behavioural features of transactions and entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.operators.ordered import micros, previous, week_of

#: One coin in its smallest units; sums just under a whole coin are structured, multiples of a hundredth are round.
COIN, ROUND_UNIT, BAND = 100_000_000, 1_000_000, 80_000_000


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def entropy(values: Column) -> Column:
    """Shannon entropy of the shares, 1 for equal ones; 0 where nothing is shared."""
    whole = total(values)
    plogp = F.transform(values, lambda x: -(x / whole) * F.log(F.greatest(x / whole, F.lit(1e-12))))
    bits = F.aggregate(plogp, F.lit(0.0), lambda a, x: a + x) / F.log(F.greatest(F.size(values), F.lit(2)).cast("double"))
    return F.when(whole > 0, bits).otherwise(F.lit(0.0))


def transaction_features(utxo: DataFrame, round_unit: int = ROUND_UNIT, coin: int = COIN, band: int = BAND, digits: int | None = 6) -> DataFrame:
    """One row per transaction, built inside one projection; shares have so many digits, or all."""
    trim = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    amounts = F.transform("outputs", lambda x: x.amount)
    n = F.size("amounts")
    share = lambda kept: trim(F.size(kept) / F.greatest(n, F.lit(1)))
    rows = utxo.withColumn("amounts", amounts).withColumn("value_out", total(F.col("amounts")))
    return rows.select(
        "txid", "value_out", n.cast("long").alias("n_outputs"), F.size("inputs").cast("long").alias("n_inputs"),
        trim(entropy(F.col("amounts"))).alias("output_entropy"),
        trim(1 - F.size(F.array_distinct("amounts")) / F.greatest(n, F.lit(1))).alias("output_uniformity"),
        F.array_min("amounts").alias("min_out"), F.array_max("amounts").alias("max_out"),
        F.when(n == 2, trim(F.array_min("amounts") / F.greatest("value_out", F.lit(1)))).alias("peel_ratio"),
        trim(F.col("fee") / F.greatest("value_out", F.lit(1))).alias("fee_ratio"),
        trim(F.col("fee") / F.greatest(11 + 68 * F.size("inputs") + 31 * n, F.lit(1))).alias("feerate_sat_vb"),
        share(F.filter("amounts", lambda x: x % round_unit == 0)).alias("round_frac"),
        share(F.filter("amounts", lambda x: x % coin > band)).alias("structuring_frac"),
        F.hour("ts").cast("long").alias("hour_utc"), (F.weekday("ts") + 1).cast("long").alias("weekday"),
    )


def amount_features(tx: DataFrame, owners: DataFrame) -> DataFrame:
    """Per entity, over transaction_features joined with owners (txid, entity)."""
    avg = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return tx.join(owners, "txid").groupBy("entity").agg(
        F.sum("value_out").alias("total_out"), avg("value_out", "mean_value_out"), F.round(F.stddev_samp("value_out"), 4).alias("std_value_out"),
        avg("output_entropy", "output_entropy_mean"), F.round(F.min("output_entropy"), 6).alias("output_entropy_min"), F.round(F.max("output_uniformity"), 6).alias("output_uniformity_max"),
        avg("output_uniformity", "output_uniformity_mean"), avg("peel_ratio", "peel_ratio_mean"), avg((F.col("n_outputs") == 2).cast("int"), "two_output_frac"),
        avg("fee_ratio", "fee_ratio_mean"), avg("feerate_sat_vb", "mean_feerate_sat_vb"), avg("round_frac", "round_number_frac"),
        avg("structuring_frac", "structuring_proximity"), avg("n_outputs", "mean_n_outputs"), F.max("n_outputs").alias("max_n_outputs"),
        avg("n_inputs", "mean_n_inputs"), F.max("n_inputs").alias("max_n_inputs"),
    )


def script_type(address: Column) -> Column:
    """The script family that an address's form tells."""
    return (
        F.when(address.startswith("bc1p"), "p2tr")
        .when(address.startswith("bc1q") & (F.char_length(address) <= 45), "p2wpkh")
        .when(address.startswith("bc1q"), "p2wsh")
        .when(address.startswith("1"), "p2pkh")
        .when(address.startswith("3"), "p2sh")
        .otherwise("unknown")
    )


def script_features(spends: DataFrame) -> DataFrame:
    """Per entity, over (entity, script, change_script): diversity, share of the commonest, modern shares, match rate.

    Counted per script first, so that a busy entity's rows are combined before the shuffle.
    """
    match = F.sum((F.col("script") == F.col("change_script")).cast("long"))
    each = spends.groupBy("entity", "script").agg(F.count(F.lit(1)).alias("n"), match.alias("hit"), F.count("change_script").alias("known"))
    of = lambda kinds: F.round(F.sum(F.when(F.col("script").isin(kinds), F.col("n")).otherwise(0)) / F.sum("n"), 6)
    return each.groupBy("entity").agg(
        F.count(F.lit(1)).alias("script_diversity"), F.round(F.max("n") / F.sum("n"), 6).alias("script_uniformity"),
        of(["p2tr"]).alias("taproot_frac"), of(["p2tr", "p2wpkh", "p2wsh"]).alias("segwit_frac"),
        F.round(F.sum("hit") / F.nullif(F.sum("known"), F.lit(0)), 6).alias("change_script_match_rate"),
    )


def temporal_gaps(events: DataFrame) -> DataFrame:
    """Per entity, over (entity, ts, row_id): spans and gaps in whole seconds, burstiness, dormancy."""
    rows = previous(events.select("entity", "ts", "row_id", week_of("ts").alias("span")), ["entity"], "span", ["ts", "row_id"], micros("ts"), "before")
    gap = F.floor((micros("ts") - F.col("before")) / 1_000_000).cast("long")
    per = rows.select("entity", "ts", gap.alias("gap")).groupBy("entity").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_tx_sent"),
        F.round(F.avg("gap"), 4).alias("gap_mean"), F.round(F.stddev_samp("gap"), 4).alias("gap_std"), F.max("gap").alias("gap_max"),
        F.median("gap").alias("gap_median"), F.round(F.avg((F.weekday("ts") >= 5).cast("int")), 6).alias("weekend_ratio"),
    )
    span = (F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))) / 1_000_000
    return per.select(
        "*", F.round(span / 86400, 6).alias("lifespan_days"),
        (F.round((F.col("gap_std") - F.col("gap_mean")) / F.greatest(F.col("gap_std") + F.col("gap_mean"), F.lit(1.0)), 4) + F.lit(0.0)).alias("burstiness"),
        F.round(F.col("gap_max") / F.greatest(span, F.lit(1.0)), 6).alias("dormancy_ratio"),
    )


def hourly_features(events: DataFrame) -> DataFrame:
    """Per entity, over (entity, ts, amount): entropy over hours of the day, the busiest hour, the Gini index of hours.

    The second level has at most 24 rows an entity.
    """
    hours = events.groupBy("entity", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("v"))
    own = W.partitionBy("entity")
    ranked = hours.select("*", F.sum("n").over(own).alias("all_n"), F.sum("v").over(own).alias("all_v"), F.row_number().over(own.orderBy("v", "hour")).alias("i"), F.count(F.lit(1)).over(own).alias("k"))
    share = F.col("n") / F.col("all_n")
    gini = F.when(F.max("all_v") > 0, F.round(2 * F.sum(F.col("i") * F.col("v")) / (F.max("k") * F.max("all_v")) - (F.max("k") + 1) / F.max("k"), 6)).otherwise(F.lit(0.0))
    return ranked.groupBy("entity").agg(
        F.round(F.sum(-share * F.log(share)) / F.log(F.lit(24.0)), 6).alias("hour_entropy"), F.max("n").alias("peak_hour_tx"),
        F.round(F.max("v") / F.nullif(F.max("all_v"), F.lit(0)), 6).alias("peak_hour_value_frac"), gini.alias("hourly_value_gini"),
    )


def network_features(announced: DataFrame, owners: DataFrame) -> DataFrame:
    """Per entity, over announcements joined with owners (txid, entity)."""
    share = lambda c, name: F.round(F.avg(c.cast("int")), 6).alias(name)
    port = F.col("src_port")
    agg = announced.join(owners, "txid").groupBy("entity").agg(
        F.count_distinct("src_ip").alias("n_ips"), F.count(F.lit(1)).alias("n_announcements"), F.count_distinct("txid").alias("n_tx_observed"),
        F.count_distinct("src_asn").alias("n_asns"), share(F.col("is_tor"), "tor_frac"), share(F.col("is_vpn"), "vpn_frac"),
        share(port == 8333, "listening_node_ratio"), share(port.between(32768, 60999), "ephemeral_linux_frac"), share(port >= 49152, "ephemeral_windows_frac"),
        F.count_distinct("src_port").alias("n_src_ports"), share(F.col("dst_port") != 8333, "nonstandard_dst_port_frac"),
    )
    per = lambda a, b, name: F.round(F.col(a) / F.greatest(b, F.lit(1)), 6).alias(name)
    return agg.select("*", per("n_announcements", "n_tx_observed", "announcements_per_tx"), per("n_ips", "n_tx_observed", "ip_churn_rate"))


def entity_ip_counts(announced: DataFrame, owners: DataFrame) -> DataFrame:
    """The sparse entity x address matrix as (entity, src_ip, n)."""
    return announced.join(owners, "txid").groupBy("entity", "src_ip").agg(F.count(F.lit(1)).alias("n"))


def collapse_announcements(announced: DataFrame) -> DataFrame:
    """One row per transaction: first sighting, its payload, how often and by how many it was seen."""
    first = F.struct("ts", "row_id")
    return announced.groupBy("txid").agg(
        F.min("ts").alias("ts"), F.min_by("src_ip", first).alias("first_ip"), F.min_by("src_port", first).alias("first_port"),
        F.count(F.lit(1)).alias("n_seen"), F.count_distinct("src_ip").alias("n_ips"), F.count_distinct("src_asn").alias("n_asns"),
    )


def censoring_features(events: DataFrame) -> DataFrame:
    """Per entity, over (entity, ts, amount): rates against the window of the whole capture (one row, broadcast)."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    ends = events.agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    per = events.groupBy("entity").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"), F.sum("amount").alias("v"))
    all_days, own_days = (seconds("end") - seconds("start")) / 86400, (seconds("last_ts") - seconds("first_ts")) / 86400
    left = (seconds("end") - seconds("first_ts")) / 86400
    return per.join(F.broadcast(ends)).select(
        "entity", F.round(left / F.greatest(all_days, F.lit(1e-9)), 6).alias("window_coverage"),
        F.round(F.col("n") / F.greatest(left, F.lit(1.0)), 6).alias("tx_per_available_day"), F.round(F.col("v") / F.greatest(left, F.lit(1.0)), 4).alias("value_per_available_day"),
        (seconds("end") - seconds("last_ts") < 86400).alias("right_censored"), F.round(own_days / F.greatest(all_days, F.lit(1e-9)), 6).alias("span_fraction_of_capture"),
    )


def attach_entities(utxo: DataFrame, owners: DataFrame) -> DataFrame:
    """txid, sender_entity, receiver_entities (distinct, sorted, comma-joined): by (address, entity)."""
    sender = utxo.select("txid", F.element_at("inputs", 1).alias("address")).join(owners, "address", "left").select("txid", F.col("entity").alias("sender_entity"))
    got = utxo.select("txid", F.explode("outputs.address").alias("address")).join(owners, "address")
    got = got.groupBy("txid").agg(F.array_join(F.array_sort(F.collect_set("entity")), ",").alias("receiver_entities"))
    return sender.join(got, "txid", "left").na.fill({"receiver_entities": ""})


def transaction_head(tx: DataFrame, owners: DataFrame) -> DataFrame:
    """Transaction features beside their entity's: parent_n_tx, value_share_of_entity, in_out_ratio_tx."""
    own = W.partitionBy("entity")
    joined = tx.join(owners, "txid", "left")
    known = F.col("entity").isNotNull()
    return joined.select(
        "txid", "value_out", "n_inputs", "n_outputs", "fee_ratio",
        F.when(known, F.count(F.lit(1)).over(own)).otherwise(0).cast("long").alias("parent_n_tx"),
        F.when(known, F.round(F.col("value_out") / F.greatest(F.sum("value_out").over(own), F.lit(1)), 6)).otherwise(F.lit(0.0)).alias("value_share_of_entity"),
        F.round(F.col("n_inputs") / F.greatest("n_outputs", F.lit(1)), 6).alias("in_out_ratio_tx"),
    )


def matrix(families: list[DataFrame], key: str = "entity") -> DataFrame:
    """One row an entity with the columns of all families (each one row an entity); what a family lacks is null.

    The families have one key, so the full joins share its partitioning.
    """
    return reduce(lambda a, b: a.join(b, key, "full"), families)
