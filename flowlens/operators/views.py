"""What people look at: dashboards, desks, timelines, changes, samples; and the tables that keep versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.operators.ordered import micros, previous, week_of


def latest(versions: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key: what an upsert leaves, over tables that are only appended to."""
    return versions.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def replay(events: DataFrame) -> DataFrame:
    """(address, since) of what is frozen now, over (address, ts, seq, added): the first addition after the last removal."""
    removed = events.where("not added").groupBy("address").agg(F.max(F.struct("ts", "seq")).alias("last"))
    after = events.where("added").join(removed, "address", "left").where(F.col("last").isNull() | (F.struct("ts", "seq") > F.col("last")))
    return after.groupBy("address").agg(F.min("ts").alias("since"))


def released(events: DataFrame) -> DataFrame:
    """Addresses that were removed and aren't frozen now."""
    return events.where("not added").select("address").distinct().join(replay(events), "address", "left_anti")


def changes(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two snapshots that came or went, with `change`."""
    a, b = before.select(keys).distinct(), now.select(keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("new")).unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("gone")))


def diff(before: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """key, status: same, changed, gone or added between two maps."""
    joined = before.select(key, F.col(value).alias("was"), F.lit(1).alias("p")).join(now.select(key, F.col(value).alias("is"), F.lit(1).alias("q")), key, "full")
    status = F.when(F.col("q").isNull(), "gone").when(F.col("p").isNull(), "added").when(F.col("was") == F.col("is"), "same").otherwise("changed")
    return joined.select(key, status.alias("status"))


def round_robin(rows: DataFrame, group: str, order: list[Column], quota: int) -> DataFrame:
    """The first of each group, then the second of each, until the quota is full."""
    deep = rows.withColumn("depth", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return deep.where(F.col("depth") <= quota).orderBy("depth", group).limit(quota)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """(total, place, ...): so many rows in the order from the offset on, each with how many rows there are in all and its
    place, from 1. A page beyond the end is one row with the total and nulls. The order should be total."""
    found = rows.orderBy(*order).offset(offset).limit(limit)
    placed = found.withColumn("place", (F.row_number().over(W.orderBy(*order)) + offset).cast("long"))  # of the page only
    return rows.agg(F.count(F.lit(1)).alias("total")).join(placed, F.lit(True), "left").select("total", "place", *rows.columns)


def search_frozen(frozen: DataFrame, text: str | None = None, chain: str | None = None) -> DataFrame:
    """Rows of (address, chain, ...) of a chain whose address holds the text, case aside; without either, all."""
    found = frozen if chain is None else frozen.where(F.col("chain") == chain)
    return found if not text else found.where(F.contains(F.lower("address"), F.lit(text.lower())))


def check_sample(frozen: DataFrame, gone: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(address, expected): n addresses that are frozen and n that were, to ask the chain about; the same for the same seed."""
    drawn = lambda df, told: df.select("address").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}-"), "address").cast("binary")), "address").limit(n).withColumn("expected", F.lit(told))
    return drawn(frozen, True).unionByName(drawn(gone, False))


def filter_cases(cases: DataFrame, outcome: str | None = None, status: str | None = None, threat: str | None = None) -> DataFrame:
    """Cases (outcome, status, threats, an array) that are as asked; threat `any`: those that touch one at all. A case
    without threats (null) touches none."""
    for column, wanted in (("outcome", outcome), ("status", status)):
        cases = cases if wanted is None else cases.where(F.col(column) == wanted)
    if threat is None:
        return cases
    return cases.where(F.size(F.coalesce("threats", F.array().cast("array<string>"))) > 0 if threat == "any" else F.array_contains("threats", threat))


def timeline(events: DataFrame, key: str) -> DataFrame:
    """events (key, ts, seq, kind) with seconds since the one before and since the first."""
    rows = events.select(key, "ts", "seq", "kind", micros("ts").alias("at"), week_of("ts").alias("span"))
    rows = previous(rows, [key], "span", ["ts", "seq"], F.col("at"), "before")
    rows = rows.join(events.groupBy(key).agg(F.min(micros("ts")).alias("first")), key)
    since = lambda other: F.floor((F.col("at") - F.col(other)) / 1_000_000).cast("long")
    return rows.select(key, "ts", "seq", "kind", since("before").alias("after_s"), since("first").alias("since_first_s"))


def interval_join(sweeps: DataFrame, payments: DataFrame, seconds: int) -> DataFrame:
    """Pairs (address, sweep_id, pay_id, payer) where the payment came at most so many seconds before the sweep.

    Time is cut into spans of that length; a payment is looked for in its own span and the one before, so the join has
    equal keys and a busy address doesn't meet all of its history.
    """
    span = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    left = sweeps.withColumn("spans", F.array(span("sweep_ts"), span("sweep_ts") - 1)).withColumn("span", F.explode("spans")).drop("spans")
    right = payments.withColumn("span", span("pay_ts"))
    gap = F.unix_micros(F.col("sweep_ts").cast("timestamp")) - F.unix_micros(F.col("pay_ts").cast("timestamp"))
    return left.join(right, ["address", "span"]).where((gap >= 0) & (gap <= seconds * 1_000_000)).select("address", "sweep_id", "pay_id", "payer")


def stations(served: DataFrame, least: int = 10, share: float = 0.95) -> DataFrame:
    """payer, entity, n_addresses: payers (payer, address, entity) that serve many addresses, nearly all of one entity."""
    per = served.groupBy("payer", "entity").agg(F.count_distinct("address").alias("n"))
    best = per.groupBy("payer").agg(F.max_by("entity", F.struct("n", "entity")).alias("entity"), F.max("n").alias("most"), F.sum("n").alias("n_addresses"))
    return best.where((F.col("n_addresses") >= least) & (F.col("most") >= share * F.col("n_addresses"))).select("payer", "entity", "n_addresses")


def chain_breaks(rows: DataFrame, log: str, seq: str, payload: Column, digest: str, step: int = 10_000) -> DataFrame:
    """log, seq of rows whose digest isn't that of the payload before them and their own; seq is a whole number."""
    rows = previous(rows.withColumn("__span", F.expr(f"{seq} div {step}")), [log], "__span", [seq], payload, "__before")
    expected = F.sha2(F.concat(F.coalesce("__before", F.lit("")), payload).cast("binary"), 256)
    return rows.withColumn("ok", F.col(digest) == expected).where("not ok").select(log, seq)


def linked_cases(reached: DataFrame, least: int = 2) -> DataFrame:
    """address, n_cases, n_suspects, first_ts, amount: wallets (address, case_id, suspect, ts, amount) that several suspects reach."""
    per = reached.groupBy("address").agg(
        F.count_distinct("case_id").alias("n_cases"), F.count_distinct("suspect").alias("n_suspects"), F.min("ts").alias("first_ts"), F.sum("amount").alias("amount")
    )
    return per.where(F.col("n_suspects") >= least)


def deposit_features(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per wallet, over (wallet, ts, is_in, amount, far) and LIFO pairs: the fourteen that tell a deposit address."""
    is_in, out = F.col("is_in"), ~F.col("is_in")
    basic = events.groupBy("wallet").agg(
        F.count_if(is_in).alias("n_in"), F.count_if(out).alias("n_out"), F.sum(F.when(is_in, F.col("amount"))).alias("got"),
        F.count_distinct(F.when(is_in, F.col("far"))).alias("n_senders"), F.count_distinct(F.when(out, F.col("far"))).alias("n_recipients"),
    )
    top = events.where(out).groupBy("wallet", "far").agg(F.sum("amount").alias("v")).groupBy("wallet").agg(F.round(F.max("v") / F.nullif(F.sum("v"), F.lit(0)), 6).alias("top_recipient_share"))
    used = pairs.groupBy("wallet").agg(F.sum("amount").alias("forwarded"), F.median("wait_s").alias("dwell_median_s"))
    paid = previous(events.where(out).withColumn("span", week_of("ts")), ["wallet"], "span", ["ts", "event_id"], micros("ts"), "before")
    sweeps = paid.withColumn("gap", (micros("ts") - F.col("before")) / 1_000_000).groupBy("wallet").agg(F.when(F.count("gap") >= 2, F.round(F.stddev_pop("gap") / F.nullif(F.avg("gap"), F.lit(0.0)), 4)).alias("sweep_gap_cv"))
    joined = basic.join(top, "wallet", "left").join(used, "wallet", "left").join(sweeps, "wallet", "left")
    ratio = F.round(F.coalesce("forwarded", F.lit(0)) / F.nullif(F.col("got"), F.lit(0)), 6)
    return joined.select(
        "wallet", "n_in", "n_out", "n_senders", "n_recipients", F.round(F.col("n_out") / F.greatest("n_in", F.lit(1)), 6).alias("out_per_in"), ratio.alias("forward_ratio"),
        F.round(1 - ratio, 6).alias("left_share"), "top_recipient_share", "dwell_median_s", "sweep_gap_cv",
    )
