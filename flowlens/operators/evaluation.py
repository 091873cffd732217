"""Tables that judge rules and methods, and layouts of what a trace found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.operators import metrics


def confusion(rows: DataFrame, rule: str, truth: str = "y") -> DataFrame:
    """tp, fp, fn, tn of one boolean rule."""
    hit, y = F.col(rule), F.col(truth) == 1
    return rows.agg(*[F.count_if(c).alias(n) for n, c in (("tp", hit & y), ("fp", hit & ~y), ("fn", ~hit & y), ("tn", ~hit & ~y))])


def by_depth(claims: DataFrame) -> DataFrame:
    """hops (null: all), n, named, wrong, error of claims (hops, named, right)."""
    per = claims.rollup("hops").agg(F.count(F.lit(1)).alias("n"), F.count_if("named").alias("named"), F.count_if(F.col("named") & ~F.col("right")).alias("wrong"))
    return per.withColumn("error", F.round(F.col("wrong") / F.nullif(F.col("named"), F.lit(0)), 6))


def fired(rows: DataFrame, arms: tuple[str, str]) -> DataFrame:
    """code, in each arm how many rows fired it, and the exact p of the difference, over (idx, arm, codes)."""
    sizes = {r["arm"]: r["count"] for r in rows.groupBy("arm").count().collect()}  # two rows
    n0, n1 = (sizes.get(a, 0) for a in arms)
    wide = rows.select("arm", F.explode(F.array_distinct("codes")).alias("code")).groupBy("code").pivot("arm", list(arms)).agg(F.count(F.lit(1))).na.fill(0)
    a, b = F.col(arms[0]), F.col(arms[1])
    return wide.withColumn("p", F.round(metrics.fisher(a, n0 - a, b, n1 - b), 8))


def nearest_rank(rows: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """group, share, value: the ordered value at floor(share * (n - 1))."""
    own = W.partitionBy(group)
    placed = rows.select(group, value, F.row_number().over(own.orderBy(value)).alias("i"), F.count(F.lit(1)).over(own).alias("n"))
    wanted = F.explode(F.array(*map(F.lit, shares))).alias("share")
    return placed.select(group, value, "i", "n", wanted).where(F.col("i") == F.floor(F.col("share") * (F.col("n") - 1)) + 1).select(group, "share", value)


def layout(wallets: DataFrame, boxes: int = 18, per_column: int = 7) -> DataFrame:
    """origin, hop, wallet, place: the boxes of a picture: the largest of each column, then of all; must-show first."""
    first = [F.col("must").desc(), F.col("amount").desc(), "wallet"]
    columns = wallets.withColumn("c", F.row_number().over(W.partitionBy("origin", "hop").orderBy(*first))).where(F.col("c") <= per_column)
    return columns.withColumn("place", F.row_number().over(W.partitionBy("origin").orderBy(*first)).cast("long")).where(F.col("place") <= boxes).select("origin", "hop", "wallet", "place")


def chase(steps: DataFrame, rounds: int) -> DataFrame:
    """wallet, end, length: following each wallet's pointer (wallet, next) until it stops or comes round.

    Pointers double every round, so a chain of n takes log n rounds.
    """
    at = steps.select("wallet", F.col("next").alias("end"), F.lit(1).cast("long").alias("length"))
    for _ in range(rounds):
        far = at.select(F.col("wallet").alias("end"), F.col("end").alias("then"), F.col("length").alias("more"))
        at = at.join(far, "end", "left").select("wallet", F.coalesce(F.when(F.col("then") != F.col("wallet"), F.col("then")), F.col("end")).alias("end"), (F.col("length") + F.when(F.col("then") != F.col("wallet"), F.col("more")).otherwise(0)).alias("length"))
        at = at.withColumn("length", F.coalesce("length", F.lit(1)))
    return at


def fold(wallets: DataFrame, per_column: int) -> DataFrame:
    """origin, hop, wallet, amount, n: the largest wallets of each column, and all others of it as one row `more`."""
    best = W.partitionBy("origin", "hop").orderBy(F.col("amount").desc(), "wallet")
    name = F.when(F.row_number().over(best) <= per_column, F.col("wallet")).otherwise("more")
    return wallets.select("origin", "hop", name.alias("wallet"), "amount").groupBy("origin", "hop", "wallet").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))


def replay_steps(edges: DataFrame) -> DataFrame:
    """origin, step, from_addr, to_addr, first_time, traced: a trace's arrows in the order in which they first appear."""
    arrows = edges.groupBy("origin", "from_addr", "to_addr").agg(F.min("block_time").alias("first_time"), F.sum("traced").alias("traced"))
    step = F.row_number().over(W.partitionBy("origin").orderBy("first_time", "from_addr", "to_addr")).cast("long")
    return arrows.select("origin", step.alias("step"), "from_addr", "to_addr", "first_time", "traced")


def days(events: DataFrame, key: str) -> DataFrame:
    """key, day, n, n_in, gap_days, arrived_s over (key, ts, is_in): active days, the days since the one before, and
    the seconds from the last arrival up to the day's first departure."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    own = W.partitionBy(key).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    since = F.when(~F.col("is_in"), micros - F.last(F.when(F.col("is_in"), micros), ignorenulls=True).over(own))
    per = events.withColumn("since", since).groupBy(key, F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_in").alias("n_in"), F.floor(F.min_by("since", F.when(~F.col("is_in"), F.struct("ts", "event_id"))) / 1_000_000).cast("long").alias("arrived_s")
    )
    gap = F.datediff("day", F.lag("day").over(W.partitionBy(key).orderBy("day"))).cast("long")
    return per.withColumn("gap_days", gap)


def with_queued(ranked: DataFrame, queued: DataFrame, first: int) -> DataFrame:
    """The first candidates of each origin and every queued entity (origin, entity) beyond them."""
    late = ranked.where(F.col("rank") > first).join(queued, ["origin", "entity"], "left_semi")
    return ranked.where(F.col("rank") <= first).unionByName(late)
