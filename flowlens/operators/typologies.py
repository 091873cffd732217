"""Patterns of movement, and the risk that they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Different recipients within the window, and different senders, from which on a wallet is flagged.
FAN_OUT, FAN_IN = 5, 5


def fan_out(payments: DataFrame, hours: int = 24) -> DataFrame:
    """sender, most: the most different recipients within any window of so many hours, over (sender, ts, to_addr).

    A busy sender's history is cut into days of that length; a day's windows need that day and the one before, so
    each payment goes to two parts and no task needs a whole history. A payment counts in the windows that end from
    its time on until its recipient is paid again, or until it is out of the window: it comes, and goes, so how many
    count at a time is a running sum, and no set is gathered.
    """
    width = hours * 3600 * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = payments.select("sender", "to_addr", at.alias("at")).distinct().withColumn("day", F.floor(F.col("at") / width))
    parts = rows.select("sender", "to_addr", "at", F.explode(F.array(F.col("day"), F.col("day") + 1)).alias("part"))
    again = F.lead("at").over(W.partitionBy("sender", "part", "to_addr").orderBy("at"))
    gone = F.least(again, F.col("at") + width + 1).alias("gone")
    spans = parts.select("sender", "part", "at", gone)
    steps = spans.select("sender", "part", "at", F.lit(1).alias("d")).unionByName(spans.select("sender", "part", F.col("gone").alias("at"), F.lit(-1).alias("d")))
    steps = steps.groupBy("sender", "part", "at").agg(F.sum("d").alias("d"))
    counted = steps.withColumn("n", F.sum("d").over(W.partitionBy("sender", "part").orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    # windows that end in the part itself: the day before is there only for what it still counts
    counted = counted.where(F.floor(F.col("at") / width) == F.col("part"))
    return counted.groupBy("sender").agg(F.max("n").cast("long").alias("most"))


def fan_in(transfers: DataFrame, least: int) -> DataFrame:
    """wallet, n_senders: wallets that at least so many others pay into."""
    senders = transfers.where("from_addr <> to_addr").groupBy(F.col("to_addr").alias("wallet")).agg(F.count_distinct("from_addr").alias("n_senders"))
    return senders.where(F.col("n_senders") >= least)


def rapid(pairs: DataFrame, events: DataFrame, share: float = 0.9, seconds: int = 600) -> DataFrame:
    """wallet, forwarded, received, slowest_s, rapid: wallets that pass on nearly all they get, and quickly.

    pairs: outflows matched with arrivals; one that no arrival before it covers waits for ever.
    """
    wait = F.when(F.col("wait_s") >= 0, F.col("wait_s"))
    used = pairs.groupBy("wallet").agg(F.sum("amount").alias("forwarded"), F.max(wait).alias("slowest_s"), F.max((F.col("wait_s") < 0).cast("int")).alias("early"))
    got = events.where("is_in").groupBy("wallet").agg(F.sum("amount").alias("received"))
    flag = (F.col("early") == 0) & (F.col("forwarded") >= F.col("received") * share) & (F.col("slowest_s") <= seconds)
    return got.join(used, "wallet").select("wallet", "forwarded", "received", F.when(F.col("early") == 0, F.col("slowest_s")).alias("slowest_s"), flag.alias("rapid"))


def peels(transfers: DataFrame, share: float = 0.7) -> DataFrame:
    """wallet, n_recipients, main, main_share: wallets that pay several, one of them most of it."""
    each = transfers.where("from_addr <> to_addr").groupBy("from_addr", "to_addr").agg(F.sum("amount").alias("v"))
    best = F.max_by("to_addr", F.struct("v", "to_addr"))
    per = each.groupBy(F.col("from_addr").alias("wallet")).agg(F.count(F.lit(1)).alias("n_recipients"), best.alias("main"), F.round(F.max("v") / F.sum("v"), 6).alias("main_share"))
    return per.where((F.col("n_recipients") >= 2) & (F.col("main_share") >= share))


def round_amounts(transfers: DataFrame, unit: int, least: int = 3, share: float = 0.5) -> DataFrame:
    """wallet, n_round, n: wallets whose stablecoin payments are often multiples of the unit."""
    per = transfers.where("asset <> 'COIN'").groupBy(F.col("from_addr").alias("wallet")).agg(F.count_if(F.col("amount") % unit == 0).alias("n_round"), F.count(F.lit(1)).alias("n"))
    return per.where((F.col("n_round") >= least) & (F.col("n_round") >= share * F.col("n")))


CLASSES = [("low", 0), ("medium", 25), ("high", 50), ("severe", 75)]
PATTERN_CAP, SCORE_CAP = 20, 100


def class_of(score: Column) -> Column:
    found = F.lit(CLASSES[0][0])
    for name, least in CLASSES[1:]:
        found = F.when(score >= least, name).otherwise(found)
    return found


def merge_indicators(found: DataFrame) -> DataFrame:
    """One row per (wallet, code) of (wallet, code, points, is_pattern, tx_hash): most points, how many transactions."""
    return found.groupBy("wallet", "code").agg(F.max("points").alias("points"), F.max("is_pattern").alias("is_pattern"), F.count_distinct("tx_hash").alias("n_txs"))


def risk_total(merged: DataFrame) -> DataFrame:
    """wallet, score, class: patterns count up to their cap, all together up to 100."""
    of = lambda flag: F.coalesce(F.sum(F.when(F.col("is_pattern") == flag, F.col("points"))), F.lit(0))
    score = F.least(F.lit(SCORE_CAP), F.least(F.lit(PATTERN_CAP), of(True)) + of(False))
    return merged.groupBy("wallet").agg(score.alias("score")).withColumn("class", class_of(F.col("score")))


def risk_flows(found: DataFrame) -> DataFrame:
    """tx_hash, score, class: a payment's points, each code counted once with its most."""
    per = found.groupBy("tx_hash", "code").agg(F.max("points").alias("points"))
    return per.groupBy("tx_hash").agg(F.least(F.lit(SCORE_CAP), F.sum("points")).alias("score")).withColumn("class", class_of(F.col("score")))


SEVERITY = {"sanctioned": "high", "mixer": "high", "bridge": "medium", "fan_in": "low"}


def flags(edges: DataFrame, labels: DataFrame, merge_from: int = 3) -> DataFrame:
    """origin, code, severity, wallet, amount, share, hops, n_tx: what a trace came to that is worth a look.

    Contacts with labelled wallets of some categories, and wallets at which several traced senders meet.
    """
    totals = edges.where("hop = 1").groupBy("origin").agg(F.sum("traced").alias("total"))
    per = edges.groupBy("origin", F.col("to_addr").alias("wallet")).agg(
        F.sum("traced").alias("amount"), F.min("hop").cast("long").alias("hops"), F.count_distinct("from_addr").alias("senders")
    )
    # counted apart: two distinct counts in one grouping lay every row out three times
    per = per.join(edges.groupBy("origin", F.col("to_addr").alias("wallet")).agg(F.count_distinct("tx_hash").alias("n_tx")), ["origin", "wallet"])
    contact = per.join(labels.where(F.col("category").isin("sanctioned", "mixer", "bridge")).select(F.col("address").alias("wallet"), F.col("category").alias("code")), "wallet")
    merged = per.where(F.col("senders") >= merge_from).withColumn("code", F.lit("fan_in"))
    rows = contact.unionByName(merged).join(totals, "origin")
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("code")]
    return rows.select("origin", "code", severity.alias("severity"), "wallet", "amount", F.round(F.col("amount") / F.col("total"), 6).alias("share"), "hops", "n_tx")
