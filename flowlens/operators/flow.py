"""Following money: first-out-after-arrival allocation, bounded tracing, routes and what became of the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.operators.ordered import micros, running_sum, week_of
from flowlens.operators.utxo import SINKS
from flowlens.session import cut, laid_out


def allocate(events: DataFrame, keys: list[str], order: list[Column], span: str = "span") -> DataFrame:
    """events (keys, span, is_in, amount) with `take` and `pool`: arrivals fill a pool that outflows drain in order.

    A pool is a running sum reflected at zero: with S the running sum of signed amounts and M the least of 0 and the
    running minimum of S, the pool is S - M and an outflow takes what the pool loses by it. Both are prefix sums that
    combine, so events are summed within spans of time first (span must rise with order), prefix sums run over the
    few spans of a key, and no task needs all events of a busy one.
    """
    signed = F.when(F.col("is_in"), F.col("amount")).otherwise(-F.col("amount"))
    local = W.partitionBy(*keys, span).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = events.withColumn("d", signed)
    rows = rows.withColumn("s", F.sum("d").over(local)).withColumn("low", F.min("s").over(local))
    spans = rows.groupBy(*keys, span).agg(F.sum("d").alias("sum"), F.min("low").alias("min"))
    before = W.partitionBy(*keys).orderBy(span).rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("s0", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    spans = spans.withColumn("low0", F.least(F.lit(0), F.coalesce(F.min(F.col("s0") + F.col("min")).over(before), F.lit(0)))).drop("sum", "min")
    pooled = rows.join(spans, [*keys, span]).withColumn("pool", F.col("s0") + F.col("s") - F.least("low0", F.col("s0") + F.col("low")))
    before = F.lag("pool").over(W.partitionBy(*keys, span).orderBy(*order))
    drained = F.coalesce(before, F.col("s0") - F.col("low0")) - F.col("pool")
    return pooled.withColumn("take", F.when(F.col("is_in"), F.lit(0)).otherwise(drained)).drop("d", "s", "low", "s0", "low0")


@dataclass(frozen=True)
class Rules:
    hops: int = 3
    #: A wallet that pays so many others since the money came (or that so many pay) is a hub.
    hub_degree: int = 30
    #: A wallet is followed from this share of the money on, in percent.
    min_share: int = 1
    dust: int = 100
    #: Wallets followed for one origin in one direction.
    max_nodes: int = 40
    #: Payments read of a followed wallet; None reads all. What lies behind a limit is held as `truncated`.
    fetch_limit: int | None = None
    #: From so many events on a wallet's history is summed within spans of time.
    whole: int = 20_000


STABLE = ("USDT", "USDC")


def pick_asset(moves: DataFrame, origins: DataFrame, own: str = "from_addr") -> DataFrame:
    """(origin, asset): the stablecoin that the origin paid most of (or got, by own), the first on ties; else the coin."""
    # summed before the join, so that payments needn't be laid out for it
    sums = moves.groupBy(F.col(own).alias("origin"), "asset").agg(F.sum("amount").alias("paid")).join(origins.select("origin"), "origin", "left_semi")
    rank = F.struct(F.col("asset").isin(*STABLE), "paid", (F.col("asset") == STABLE[0]))
    return sums.groupBy("origin").agg(F.max_by("asset", rank).alias("asset"))


def _busy(near: DataFrame, degree: int, whole: bool) -> DataFrame:
    """(wallet, asset, busy_until) over the payments of the wallets asked for: the last time up to which so many different
    others are still to come; for ever where whole. Of each wallet the latest `degree` others are looked at."""
    last = near.groupBy("own", "asset", "far").agg(F.max("at").alias("last"))
    nth = F.row_number().over(W.partitionBy("own", "asset").orderBy(F.col("last").desc()))
    per = last.withColumn("n", nth).where(F.col("n") <= degree).groupBy(F.col("own").alias("wallet"), "asset").agg(F.count(F.lit(1)).alias("n"), F.min("last").alias("busy_until"))
    return per.where(F.col("n") == degree).select("wallet", "asset", F.lit((1 << 63) - 1).alias("busy_until") if whole else F.col("busy_until"))


@dataclass(frozen=True)
class Bridges:
    """How money leaves a chain at one wallet and comes out at another.

    wallets (wallet): the labelled wallets of bridges. matches (tx_hash, wallet, to_chain, payout_tx, recipient): of
    deposits to them, where they were paid out; to_chain is null for a chain that isn't read. Wallets of all chains are
    in one table of payments, told apart by their names (`chain:address` away from the origins' chain). payouts: the
    payments among which payouts are looked for, where they are known apart; else all.
    """

    wallets: DataFrame
    matches: DataFrame
    payouts: DataFrame | None = None


def trace(
    moves: DataFrame, origins: DataFrame, labels: DataFrame, rules: Rules = Rules(), hidden: DataFrame | None = None, inbound: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, holds, seen) of following each origin's payments; trace_across without bridges."""
    return trace_across(moves, origins, labels, rules, hidden, inbound)[:3]


def _sunk(level: DataFrame, hop: int) -> tuple[DataFrame, DataFrame]:
    """level without what goes into sinks, and that as holds at the sender."""
    kind = F.split("far", ":")[0]
    sink = F.col("far").contains(":") & kind.isin(*SINKS)
    held = level.where(sink).groupBy("origin", F.col("own").alias("wallet"), kind.alias("reason")).agg(F.sum("traced").alias("held"))
    return level.where(~sink), held.select("origin", F.lit(hop).alias("hop"), "wallet", F.col("held").alias("received"), "reason", "held")


def _one_asset(level: DataFrame, before: DataFrame | None, last: bool) -> tuple[DataFrame, DataFrame]:
    """level with `odd`, and (origin, wallet, one): of a wallet one asset is followed, that of the largest payment that
    reaches it first (of the later name on ties)."""
    if before is None:
        # an origin's own payments are of one asset
        return level.withColumn("odd", F.lit(False)), level.select("origin", F.col("far").alias("wallet"), F.col("asset").alias("one")).distinct()
    first = level.groupBy("origin", F.col("far").alias("wallet")).agg(F.max_by("asset", F.struct("traced", "asset")).alias("one"))
    first = first.join(before.withColumnRenamed("one", "earlier"), ["origin", "wallet"], "left").select("origin", "wallet", F.coalesce("earlier", "one").alias("one"), F.col("earlier").isNull().alias("new"))
    first = first if last else laid_out(first, "assets", "origin")
    chosen = first.where("new").drop("new")
    rows = level.join(first.select("origin", F.col("wallet").alias("far"), "one"), ["origin", "far"])
    return rows.withColumn("odd", F.col("asset") != F.col("one")).drop("one"), before.unionByName(chosen)


def _legs(level: DataFrame, labelled: DataFrame, totals: DataFrame, paid: DataFrame, bridges: Bridges, rules: Rules, last: bool) -> DataFrame:
    """level's deposits at bridges with status, reason and, where known, what came out: to_addr, paid, paid_asset, paid_at, out.

    For the first reason that holds a deposit isn't followed: it is a small part of the money, has no match, went to a
    chain that isn't read, came at the last hop, has no payout, or was paid out in another asset; stablecoins are one
    money. Of the payout goes on the part that the traced money is of the deposit, never more than that.
    """
    stopped = labelled.select("origin", F.col("wallet").alias("far")).distinct()
    at = stopped.join(bridges.wallets.select(F.col("wallet").alias("far")), "far")
    matches = bridges.matches.withColumnRenamed("wallet", "far").withColumn("matched", F.lit(True))
    # the bridges' wallets are few, so most of the level goes before any of it is laid out
    into = level.join(bridges.wallets.select(F.col("wallet").alias("far")), "far", "left_semi")
    rows = into.join(at, ["origin", "far"]).join(totals, "origin").join(matches, ["tx_hash", "far"], "left")
    rows = rows.join(paid, (F.col("payout_tx") == F.col("out_tx")) & (F.col("recipient") == F.col("out_addr")), "left")
    same = (F.col("asset") == F.col("paid_asset")) | (F.col("asset").isin(*STABLE) & F.col("paid_asset").isin(*STABLE))
    reason = (
        F.when(F.col("traced") * 100 < F.col("total") * rules.min_share, "small").when(F.col("matched").isNull(), "no_match").when(F.col("to_chain").isNull(), "other_chain")
        .when(F.lit(last), "depth_limit").when(F.col("paid").isNull(), "no_payout").when(~same, "asset_changed")
    )
    status = F.when(reason.isNull(), "followed").when(reason.isin("small", "no_match"), "unresolved").otherwise("not_traced")
    out = F.least("traced", F.expr("cast((cast(paid as decimal(38,0)) * traced) div amount as bigint)"))
    return rows.withColumns({"status": status, "reason": reason, "out": F.when(reason.isNull(), out)})


def _drained(events: DataFrame, many: bool, long: bool) -> DataFrame:
    """The outflows of events (origin, wallet, far, tx_hash, at, is_in, amount, ...) with `take`.

    Wallets with few events are laid out once and every sum is a window over their history; those of long histories are
    summed within spans of time. Both give the same.
    """
    order = [F.col("at"), F.col("is_in").desc(), F.col("tx_hash"), F.col("far"), F.col("amount")]
    if long:
        spans = events.withColumn("span", F.floor(F.col("at") / SPAN))
        return (_together(spans) if many else allocate(spans, ["origin", "wallet"], order).where("not is_in")).drop("span", "pool")
    # by the origin alone, as all that is asked of a trace goes by it: laid_out keeps this order
    rows = events.repartition("origin")
    want = F.when(F.col("is_in"), F.col("amount")).otherwise(-F.col("amount"))
    if many:
        # a transaction's payments count as one, at its first row
        keys = ["origin", "wallet", "at", "is_in", "tx_hash"]
        order = [F.col("at"), F.col("is_in").desc(), F.col("tx_hash"), F.col("nth")]
        rows = rows.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy("far"))).withColumn("want", F.sum("amount").over(W.partitionBy(*keys)))
        want = F.when(F.col("is_in"), F.col("amount")).when(F.col("nth") == 1, -F.col("want")).otherwise(F.lit(0))
    own = W.partitionBy("origin", "wallet").orderBy(*order)
    till = own.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("s", F.sum(want).over(till)).withColumn("pool", F.col("s") - F.least(F.lit(0), F.min("s").over(till)))
    rows = rows.withColumn("take", F.coalesce(F.lag("pool").over(own), F.lit(0)) - F.col("pool")).where("not is_in").drop("s", "pool")
    if not many:
        return rows
    given = rows.withColumn("give", F.sum(F.when(F.col("nth") == 1, F.col("take")).otherwise(F.lit(0))).over(W.partitionBy(*keys)))
    return _parts(given.withColumn("want", F.when(F.col("give") > 0, F.col("want")).otherwise(1)).drop("nth", "take"), keys)


def _parts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (give and want of their group) with `take`: each one's part of what is given, in whole units: rounded down, and
    the units left over go one each to the largest remainders (by far address on ties), so none is lost and none gets
    too much."""
    rows = rows.withColumn("part", F.expr("cast((cast(give as decimal(38,0)) * amount) div want as bigint)"))
    # give * amount mod want, without the wide product where the part is known
    rows = rows.withColumn("rest", F.expr("cast(cast(give as decimal(38,0)) * amount - cast(part as decimal(38,0)) * want as decimal(38,0))"))
    whole = W.partitionBy(*keys)
    nth = F.row_number().over(whole.orderBy(F.col("rest").desc(), "far"))
    return rows.withColumn("left", F.col("give") - F.sum("part").over(whole)).withColumn("take", F.col("part") + (nth <= F.col("left")).cast("long")).drop("left", "part", "rest", "give", "want")


def _together(events: DataFrame) -> DataFrame:
    """events with `take`, where a wallet's payments of one transaction are served together, the fee with them.

    If the money doesn't cover all of them, each gets its part in proportion.
    """
    keys = ["origin", "wallet", "tx_hash", "at"]
    groups = events.where("not is_in").groupBy(*keys, "span").agg(F.sum("amount").alias("amount"), F.lit(False).alias("is_in"))
    arrived = events.where("is_in").select(*keys, "span", "amount", "is_in")
    order = [F.col("at"), F.col("is_in").desc(), F.col("tx_hash"), F.col("amount")]
    given = allocate(arrived.unionByName(groups), ["origin", "wallet"], order).where("not is_in and take > 0").select(*keys, F.col("take").alias("give"), F.col("amount").alias("want"))
    return _parts(events.where("not is_in").join(given, keys, "left").na.fill({"give": 0, "want": 1}), keys)


def trace_across(
    moves: DataFrame, origins: DataFrame, labels: DataFrame, rules: Rules = Rules(), hidden: DataFrame | None = None, inbound: bool = False, bridges: Bridges | None = None,
    own_moves: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(edges, holds, seen, legs) of following each origin's payments of its main asset, all origins and wallets of a hop at once.

    moves: tx_hash, block_time, from_addr, to_addr, asset, amount, one row a payment. labels: address, entity, ... .
    hidden (origin, entity; or origin, address): labels that don't exist for an origin. inbound: who funded the origin, back in time.
    edges: origin, hop, tx_hash, block_time, from_addr, to_addr, amount, traced.
    holds: origin, hop, wallet, received, reason (why it wasn't followed; `kept` for what stayed behind), held.
    seen: origin, hop, tx_hash, ...: the payments read for wallets that were followed.

    legs (with bridges): origin, hop, tx_hash, from_addr, bridge, traced, status, reason, to_chain, recipient, out. A followed
    leg is an edge of the next hop, from the bridge to the recipient, of the payout's asset and time; the bridge holds
    the rest as `bridge_fee`. A wallet that gets several assets goes on in one, and holds the others as `asset_changed`.

    own_moves: on a chain whose transactions have many parties, what the origins paid themselves (utxo.flows with own), while
    moves has all funders' payments, sinks and fees. A transaction's payments are served together there. What goes into
    a sink is held at the sender, with the sink's kind as the reason, and so is its part of fees.

    Each hop reads the payments of the wallets that are asked for once: those wallets are written first, so where they
    are few they are broadcast and the other payments aren't laid out. A wallet that is labelled, the origin, at the last
    hop, small, beyond the budget of wallets or a hub isn't followed, for the first of these reasons; the share that a
    wallet must have bounds how many an origin follows.
    """
    sign, (own, far) = (-1, ("to_addr", "from_addr")) if inbound else (1, ("from_addr", "to_addr"))
    # written, so that Spark knows whether they are few enough to be broadcast
    origins = cut(origins.select("origin"))
    many = own_moves is not None
    picked = cut(pick_asset(own_moves if many else moves, origins, own))
    at = sign * F.unix_micros(F.col("block_time").cast("timestamp"))
    # these repeat other columns, so they are never written or laid out
    sided = lambda rows: rows.withColumns({"own": F.col(own), "far": F.col(far), "at": at})
    usable = lambda rows: rows.where((F.col("from_addr") != F.col("to_addr")) & (F.col("amount") >= rules.dust))
    fee = F.col("to_addr").startswith("fee:")
    real, mine = usable(moves.where(~fee)) if many else usable(moves), usable(own_moves.where(~fee)) if many else None
    first = (mine if many else real).join(picked.withColumnRenamed("asset", "pick"), (F.col(own) == F.col("origin")) & (F.col("asset") == F.col("pick")))
    columns = ["origin", "hop", "tx_hash", "block_time", "from_addr", "to_addr", "asset", "amount", "traced"]
    level = sided(laid_out(first.withColumn("hop", F.lit(1)).withColumn("traced", F.col("amount")).select(columns), "level", "origin"))
    totals = cut(level.groupBy("origin").agg(F.sum("traced").alias("total")))
    known = labels.select(F.col("address").alias("wallet"), "entity")
    edges, holds, seen, followed, legs, chosen, paid = level, None, None, None, None, None, None
    #: what payments of followed wallets have been used for, sinks and fees too; the origin's own aren't asked for again
    spent_on = None
    if many:
        level, holds = _sunk(level, 0)
        edges = level
    if bridges is not None:
        # what a recipient got in a payout: of its first stablecoin, else of its first asset
        sums = (moves if bridges.payouts is None else bridges.payouts).join(cut(bridges.matches.select(F.col("payout_tx").alias("tx_hash"), F.col("recipient").alias("to_addr")).distinct()), ["tx_hash", "to_addr"])
        sums = sums.where("from_addr <> to_addr and amount > 0").groupBy(F.col("tx_hash").alias("out_tx"), F.col("to_addr").alias("out_addr"), "asset").agg(F.sum("amount").alias("paid"), F.min("block_time").alias("time"))
        best = F.min_by(F.struct("paid", "asset", "time"), F.struct(~F.col("asset").isin(*STABLE), "asset")).alias("p")
        paid = cut(sums.groupBy("out_tx", "out_addr").agg(best).select("out_tx", "out_addr", "p.paid", F.col("p.asset").alias("paid_asset"), F.col("p.time").alias("paid_at")))
    for hop in range(1, rules.hops + 1):
        last = hop == rules.hops
        if bridges is not None:
            level, chosen = _one_asset(level, chosen, last)
            level = level if hop == 1 else sided(laid_out(level.select(*columns, "odd"), "level", "origin"))
            odd = level.where("odd").groupBy("origin", F.col("far").alias("wallet")).agg(F.sum("traced").alias("received"))
            odd = odd.select("origin", F.lit(hop).alias("hop"), "wallet", "received", F.lit("asset_changed").alias("reason"), F.col("received").alias("held"))
            holds = odd if holds is None else holds.unionByName(odd)
            level = level.where("not odd").drop("odd")
        reached = level.groupBy("origin", F.col("far").alias("wallet"), "asset").agg(F.sum("traced").alias("received"), F.min("at").alias("since"), F.count(F.lit(1)).alias("n_in"))
        reached = reached.join(known, "wallet", "left")
        if hidden is not None:
            by = "wallet" if "address" in hidden.columns else "entity"
            gone = hidden.select("origin", F.col("address" if by == "wallet" else "entity").alias(by), F.lit(True).alias("gone")).distinct()
            reached = reached.join(gone, ["origin", by], "left").withColumn("entity", F.when(F.col("gone").isNull(), F.col("entity"))).drop("gone")
        reached = reached.withColumn("labelled", F.col("entity").isNotNull()).drop("entity")
        # at the last hop only holds read it, if anybody does
        reached = reached if last and bridges is None else cut(reached)
        named, rest = reached.where("labelled"), reached.where("not labelled").drop("labelled")
        if last:
            rest = rest.withColumn("reason", F.when(F.col("wallet") == F.col("origin"), "origin").otherwise("depth_limit"))
        else:
            rest = rest.join(totals, "origin")
            rest = rest.withColumn("again", F.lit(False)) if followed is None else rest.join(followed.withColumn("again", F.lit(True)), ["origin", "wallet"], "left").na.fill(False, ["again"])
            reason = F.when(F.col("wallet") == F.col("origin"), "origin").when(~F.col("again") & (F.col("received") * 100 < F.col("total") * rules.min_share), "small")
            rest = cut(rest.withColumn("reason", reason).drop("total"))
            asked = cut(rest.where("reason is null").select(F.col("wallet").alias(own), "asset").distinct())
            # by the wallet alone, so that payments which are dealt by it stay where they are
            wanted = asked.groupBy(own).agg(F.collect_set("asset").alias("of"))
            near = sided(cut(real.join(wanted, own).where(F.array_contains("of", F.col("asset"))).drop("of")))
            busy = cut(_busy(near, rules.hub_degree, inbound))
            rest = cut(_chosen(rest, followed, busy, rules))
        held = lambda rows, reason: rows.select("origin", F.lit(hop).alias("hop"), "wallet", "received", reason.alias("reason"), F.col("received").alias("held"))  # noqa: B023, E731
        stopped = held(named, F.lit("labelled")).unionByName(held(rest.where("reason is not null"), F.col("reason")))
        crossed = None
        if bridges is not None:
            now = cut(_legs(level, named, totals, paid, bridges, rules, last))
            told = now.select("origin", "hop", "tx_hash", "from_addr", F.col("far").alias("bridge"), "traced", "status", "reason", "to_chain", "recipient", "out")
            legs = told if legs is None else legs.unionByName(told)
            gone = now.where("status = 'followed'").groupBy("origin", F.col("far").alias("wallet")).agg(F.sum("traced").alias("gone"), F.sum("out").alias("passed"))
            stopped = stopped.join(gone, ["origin", "wallet"], "left").withColumn("held", F.col("held") - F.coalesce("gone", F.lit(0))).drop("gone", "passed")
            kept_fees = gone.select("origin", F.lit(hop).alias("hop"), "wallet", F.col("gone").alias("received"), F.lit("bridge_fee").alias("reason"), (F.col("gone") - F.col("passed")).alias("held"))
            stopped = stopped.unionByName(kept_fees)
            away = now.where("status = 'followed' and out > 0").select(
                "origin", F.lit(hop + 1).alias("hop"), F.col("payout_tx").alias("tx_hash"), F.col("paid_at").alias("block_time"), F.col("far").alias("from_addr"), F.col("recipient").alias("to_addr"),
                F.col("paid_asset").alias("asset"), F.col("paid").alias("amount"), F.col("out").alias("traced"),
            )
            crossed = sided(away.select(columns))
        holds = stopped if holds is None else holds.unionByName(stopped)
        if last:
            break
        # a history so long that no task should hold it
        crowded = cut(near.groupBy(F.col("own").alias("wallet"), "asset").agg(F.count(F.lit(1)).alias("n_out")).where(F.col("n_out") > rules.whole))
        front = rest.where("reason is null").join(crowded, ["wallet", "asset"], "left")
        front = cut(front.select("origin", "wallet", "asset", "since", "received", "again", (F.col("n_out").isNotNull() | (F.col("n_in") > rules.whole)).alias("long")))
        out = near.join(front.withColumnRenamed("asset", "of"), (F.col("own") == F.col("wallet")) & (F.col("asset") == F.col("of")) & (F.col("at") >= F.col("since"))).drop("of", "since", "received")
        cut_off = None
        if rules.fetch_limit is not None:
            out = cut(out.withColumn("nth", F.row_number().over(W.partitionBy("origin", "wallet").orderBy("at", "tx_hash", "far"))).where(F.col("nth") <= rules.fetch_limit + 1))
            cut_off = out.where(F.col("nth") > rules.fetch_limit).select("origin", "wallet", F.lit(True).alias("more"))
            out = out.where(F.col("nth") <= rules.fetch_limit).drop("nth")
        paid_out = ["origin", "wallet", "tx_hash", "block_time", "far", "asset", "amount", "at", "again", "long"]
        out = out.select(paid_out)
        if many:
            fees = sided(moves.where(fee).join(asked.select(own).distinct(), own, "left_semi").drop("asset"))
            paying = out.select("origin", "wallet", "asset", "tx_hash", "at", "again", "long").distinct()
            out = out.unionByName(fees.join(paying.withColumn("own", F.col("wallet")), ["own", "tx_hash", "at"]).select(paid_out))
        if spent_on is None:
            out = out.withColumn("available", F.col("amount"))
        else:
            back = front.where("again").select("origin", F.col("wallet").alias("own"))
            used = spent_on.join(back, ["origin", "own"], "left_semi").groupBy("origin", F.col("own").alias("wallet"), "far", "tx_hash", "block_time").agg(F.sum("traced").alias("used"))
            anew = out.where("again").join(cut(used), ["origin", "wallet", "far", "tx_hash", "block_time"], "left").withColumn("available", F.col("amount") - F.coalesce("used", F.lit(0)))
            out = out.where("not again").withColumn("available", F.col("amount")).unionByName(anew.drop("used"))
        came = level.join(asked.select(F.col(own).alias("far")).distinct(), "far", "left_semi").select("origin", F.col("far").alias("wallet"), "tx_hash", "block_time", F.col("own").alias("far"), "asset", "amount", "at", "traced")
        arrivals = came.join(front.select("origin", "wallet", "long"), ["origin", "wallet"])
        common = ["origin", "wallet", "tx_hash", "block_time", "far", "asset", F.col("amount").alias("full"), "at", "long"]
        events = arrivals.select(*common, F.lit(True).alias("is_in"), F.col("traced").alias("amount")).unionByName(out.select(*common, F.lit(False).alias("is_in"), F.col("available").alias("amount")))
        drained = _drained(events.where("not long").drop("long"), many, False)
        if not front.where("long").isEmpty():
            drained = drained.unionByName(_drained(events.where("long").drop("long"), many, True).select(drained.columns))
        drained = drained.withColumns({"hop": F.lit(hop + 1), "amount": F.col("full"), "traced": F.col("take"), own: F.col("wallet"), far: F.col("far")})
        # the next hop and the sums below read these several times; the cut also keeps the plan from doubling with every hop
        drained = sided(laid_out(drained.select(columns), "level", "origin"))
        read = (drained.where(~fee) if many else drained).select("origin", "hop", "tx_hash", "block_time", "from_addr", "to_addr", "traced")
        seen = read if seen is None else seen.unionByName(read)
        level = drained.where("traced > 0")
        spent = level.groupBy("origin", F.col("own").alias("wallet")).agg(F.sum("traced").alias("spent"))
        spent_on = level if spent_on is None else spent_on.unionByName(level)
        if many:
            level, sunk = _sunk(level, hop)
            holds = holds.unionByName(sunk)
        kept = front.join(spent, ["origin", "wallet"], "left").withColumn("held", F.col("received") - F.coalesce("spent", F.lit(0))).withColumn("reason", F.lit("kept"))
        if cut_off is not None:
            kept = kept.join(cut_off, ["origin", "wallet"], "left").withColumn("reason", F.when(F.col("more"), "truncated").otherwise("kept"))
        holds = holds.unionByName(kept.select("origin", F.lit(hop).alias("hop"), "wallet", "received", "reason", "held"))
        front_pairs = front.select("origin", "wallet")
        followed = front_pairs if followed is None else cut(followed.unionByName(front_pairs).distinct())
        level = level if crossed is None else level.unionByName(crossed)
        edges = edges.unionByName(level)
    edges = edges.drop("own", "far", "at")
    none = edges.where("false").select("origin", "hop", "tx_hash", "block_time", "from_addr", "to_addr", "traced")
    return edges, holds, seen if seen is not None else none, legs


#: A span of time for prefix sums, in microseconds: a year.
SPAN = 365 * 86400 * 1_000_000


def _chosen(reached: DataFrame, followed: DataFrame | None, busy: DataFrame, rules: Rules) -> DataFrame:
    """reached with the reasons `budget` and `hub`: wallets are taken by what they received until the budget is spent."""
    asked = reached.where("reason is null").join(busy, ["wallet", "asset"], "left").withColumn("hub", F.coalesce(F.col("busy_until") >= F.col("since"), F.lit(False)))
    spent = F.lit(0)
    if followed is not None:
        asked, spent = asked.join(followed.groupBy("origin").agg(F.count(F.lit(1)).alias("n_before")), "origin", "left"), F.coalesce("n_before", F.lit(0))
    taken = F.when(F.col("hub") | F.col("again"), 0).otherwise(1)
    earlier = W.partitionBy("origin").orderBy(F.col("received").desc(), "wallet").rowsBetween(W.unboundedPreceding, -1)
    over = ~F.col("again") & (F.coalesce(F.sum(taken).over(earlier), F.lit(0)) + spent >= rules.max_nodes)
    asked = asked.withColumn("reason", F.when(over, "budget").when(F.col("hub"), "hub"))
    return reached.where("reason is not null").unionByName(asked.select(reached.columns))


# How far a label is trusted, by its tier.
TIER_WEIGHT = {"published_por": 0.95, "curated": 0.85, "explorer_tag": 0.75, "derived": 0.6}
DECAY, FULL_SHARE, NAMED_FROM, ALERT_SHARE = 0.85, 0.25, 0.60, 0.01


def entries(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """origin, entity, address: of a service's labelled wallets the one that got most, the least on ties."""
    into = edges.join(labels.where(F.col("category").isin("exchange", "swap")).select(F.col("address").alias("to_addr"), "entity"), "to_addr")
    got = into.groupBy("origin", "entity", F.col("to_addr").alias("address")).agg(F.sum("traced").alias("got"))
    return got.groupBy("origin", "entity").agg(F.min_by("address", F.struct(-F.col("got"), F.col("address"))).alias("address"))


def candidates(edges: DataFrame, labels: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """origin, entity, hops, received, share, confidence, first_time, rank: services that the money came to.

    Confidence is the weight of the labels' tiers, less by each hop, in full from a quarter of the money on. hidden (origin,
    address): labels that don't exist for an origin.
    """
    totals = edges.where("hop = 1").groupBy("origin").agg(F.sum("traced").alias("total"))
    weight = F.create_map(*[F.lit(x) for kv in TIER_WEIGHT.items() for x in kv])[F.col("tier")]
    into = edges.join(labels.where(F.col("category").isin("exchange", "swap")).select(F.col("address").alias("to_addr"), "entity", "tier"), "to_addr")
    if hidden is not None:
        into = into.join(hidden.select("origin", F.col("address").alias("to_addr")), ["origin", "to_addr"], "left_anti")
    strength = F.sum(weight * F.pow(F.lit(DECAY), F.col("hop") - 1) * F.col("traced"))
    found = into.groupBy("origin", "entity").agg(F.min("hop").alias("hops"), F.sum("traced").alias("received"), strength.alias("strength"), F.min("block_time").alias("first_time"))
    share = F.col("received") / F.col("total")
    found = found.join(totals, "origin").withColumn("share", F.round(share, 6))
    found = found.withColumn("confidence", F.round(F.col("strength") / F.col("received") * F.least(F.lit(1.0), share / FULL_SHARE), 4))
    order = W.partitionBy("origin").orderBy("hops", F.col("received").desc(), "first_time", "entity")
    return found.select("origin", "entity", "hops", "received", "share", "confidence", "first_time", F.row_number().over(order).cast("long").alias("rank"))


def outcome(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """origin, outcome, entity, confidence: a warning, the nearest service that is likely enough, or neither."""
    found = candidates(edges, labels)
    named = found.where(F.col("confidence") >= NAMED_FROM).groupBy("origin").agg(F.min_by(F.struct("entity", "confidence"), "rank").alias("best"))
    bad = labels.where(F.col("category").isin("sanctioned", "mixer")).select(F.col("address").alias("to_addr"))
    totals = edges.where("hop = 1").groupBy("origin").agg(F.sum("traced").alias("total"))
    alert = edges.join(bad, "to_addr").groupBy("origin").agg(F.sum("traced").alias("bad"))
    joined = totals.join(alert, "origin", "left").join(named, "origin", "left")
    what = F.when(F.coalesce("bad", F.lit(0)) >= F.col("total") * ALERT_SHARE, "SANCTIONED_OR_MIXER_REACHED").when(F.col("best").isNotNull(), "ATTRIBUTED").otherwise("INSUFFICIENT_EVIDENCE")
    return joined.select("origin", what.alias("outcome"), F.when(what == "ATTRIBUTED", F.col("best.entity")).alias("entity"), F.when(what == "ATTRIBUTED", F.col("best.confidence")).alias("confidence"))


def request_wallets(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """origin, entity, wallet, role: which wallets to ask a service about.

    Its deposit wallets; of its other wallets, the senders that passed on to it all they had received.
    """
    into = edges.join(labels.where(F.col("category").isin("exchange", "swap")).select(F.col("address").alias("to_addr"), "entity", "kind"), "to_addr")
    deposits = into.where("kind = 'deposit'").select("origin", "entity", F.col("to_addr").alias("wallet"), F.lit("deposit").alias("role")).distinct()
    got = edges.groupBy("origin", F.col("to_addr").alias("from_addr")).agg(F.sum("traced").alias("got"))
    sent = into.where("kind <> 'deposit'").groupBy("origin", "entity", "from_addr").agg(F.sum("traced").alias("sent"))
    through = sent.join(got, ["origin", "from_addr"]).where("got = sent").select("origin", "entity", F.col("from_addr").alias("wallet"), F.lit("pass_through").alias("role"))
    return deposits.unionByName(through)


def routes(edges: DataFrame, ends: DataFrame, hops: int) -> DataFrame:
    """(origin, target, step, tx_hash, from_addr, to_addr, block_time, traced) for ends (origin, target): the way back.

    The last edge of the nearest, largest arrival; then, step by step, of the edges one hop nearer that feed it in
    time, the largest, latest one: as-of joins, all ends at once.
    """
    best = lambda: F.max_by(F.struct(*[F.col(f"e.{c}") for c in ("hop", "tx_hash", "from_addr", "to_addr", "block_time", "traced")]), F.struct(-F.col("e.hop"), F.col("e.traced"), F.col("e.block_time"), F.col("e.tx_hash")))
    e = edges.alias("e")
    at = e.join(ends.alias("t"), F.expr("e.origin = t.origin and e.to_addr = t.target")).groupBy("t.origin", "t.target").agg(best().alias("x")).select("origin", "target", "x.*")
    found = at
    for _ in range(hops - 1):
        step = F.expr("e.origin = t.origin and e.hop = t.hop - 1 and e.to_addr = t.from_addr and e.block_time <= t.block_time")
        at = e.join(at.alias("t"), step).groupBy("t.origin", "t.target").agg(best().alias("x")).select("origin", "target", "x.*")
        found = found.unionByName(at)
    return found.withColumnRenamed("hop", "step")


def _ranges(rows: DataFrame, low: str, high: str) -> DataFrame:
    """rows (wallet, amount, low, high) once for each range of money that [low, high) touches, as `range` of `width`.

    A wallet's width is its mean amount, so its rows become twice as many at most.
    """
    width = rows.groupBy("wallet").agg(F.greatest(F.lit(1), F.floor(F.avg("amount"))).cast("long").alias("width"))
    spread = F.sequence(F.expr(f"{low} div width"), F.expr(f"({high} - 1) div width"))
    return rows.join(cut(width), "wallet").withColumn("range", F.explode(spread))


def lifo_pairs(events: DataFrame) -> DataFrame:
    """wallet, out_id, in_id, amount, wait_s over (wallet, event_id, ts, is_in, amount): outflows use the newest money.

    With the pool as a level, an arrival lays money on levels and an outflow takes it from them; what it takes from a
    level is what was last laid there. So levels are cut into ranges, which don't bear on each other, and a range's
    history at its times of being empty, before which nothing is left. Each such part is folded by itself: no task
    needs a busy wallet's history, but where one range never empties.
    """
    import pandas as pd

    parts = ["wallet", "range", "part"]

    def fold(batches):
        group, stack = None, []
        for batch in batches:
            rows = []
            for *own, event, ts, is_in, amount in zip(*(batch[c] for c in (*parts, "event_id", "ts", "is_in", "piece"))):
                if own != group:
                    group, stack = own, []
                if is_in:
                    stack.append([event, ts, amount])
                    continue
                while amount > 0 and stack:
                    used = min(amount, stack[-1][2])
                    rows.append((own[0], event, stack[-1][0], used, (ts - stack[-1][1]) // 1_000_000))
                    amount -= used
                    stack[-1][2] -= used
                    if not stack[-1][2]:
                        stack.pop()
            yield pd.DataFrame(rows, columns=["wallet", "out_id", "in_id", "amount", "wait_s"])

    order = [F.col("ts"), F.col("is_in").desc(), F.col("event_id")]
    rows = events.where("amount > 0").select("wallet", "event_id", micros("ts").alias("ts"), "is_in", "amount", week_of("ts").alias("span"))
    pooled = allocate(rows, ["wallet"], order)
    levels = pooled.select("wallet", "event_id", "ts", "is_in", "span", "amount", F.when(F.col("is_in"), F.col("pool") - F.col("amount")).otherwise(F.col("pool")).alias("low"), F.when(F.col("is_in"), F.col("pool")).otherwise(F.col("pool") + F.col("take")).alias("high"))
    ranged = _ranges(cut(levels.where("low < high")), "low", "high")
    floor = F.col("range") * F.col("width")
    piece = F.least("high", floor + F.col("width")) - F.greatest("low", floor)
    ranged = cut(ranged.withColumn("piece", piece).withColumn("empties", (~F.col("is_in") & (F.col("low") <= floor)).cast("int")).select("wallet", "range", "span", "event_id", "ts", "is_in", "piece", "empties"))
    told = running_sum(ranged, ["wallet", "range"], "span", order, F.col("empties"), "part").withColumn("part", F.col("part") - F.col("empties"))
    dealt = told.repartition(*parts).sortWithinPartitions(*parts, *order)
    pieces = dealt.mapInPandas(fold, "wallet string, out_id long, in_id long, amount long, wait_s long")
    return pieces.groupBy("wallet", "out_id", "in_id").agg(F.sum("amount").alias("amount"), F.first("wait_s").alias("wait_s"))


def fifo_pairs(events: DataFrame) -> DataFrame:
    """wallet, out_id, in_id, amount, wait_s: outflows use the oldest money, as an overlap join of running sums.

    Each arrival owns the interval of cumulative arrivals that it adds, each outflow that of cumulative outflows;
    where two overlap, the one paid for the other. Both axes are cut into ranges of money, so that only neighbours
    meet, and a pair counts in the first range that both touch.
    """
    rows = events.where("amount > 0").select("wallet", "event_id", "ts", "is_in", "amount", week_of("ts").alias("span"))
    summed = running_sum(rows, ["wallet", "is_in"], "span", [F.col("ts"), F.col("event_id")], F.col("amount"), "high").withColumn("low", F.col("high") - F.col("amount"))
    ranged = cut(_ranges(cut(summed), "low", "high").select("wallet", "range", "width", "event_id", "ts", "is_in", "low", "high"))
    a, b = ranged.where("is_in").alias("a"), ranged.where("not is_in").alias("b")
    first = F.col("a.range") == F.expr("greatest(a.low, b.low) div a.width")
    met = a.join(b, (F.col("a.wallet") == F.col("b.wallet")) & (F.col("a.range") == F.col("b.range"))).where((F.col("a.low") < F.col("b.high")) & (F.col("b.low") < F.col("a.high")) & first)
    wait = F.floor((micros(F.col("b.ts")) - micros(F.col("a.ts"))) / 1_000_000).cast("long")
    return met.select("a.wallet", F.col("b.event_id").alias("out_id"), F.col("a.event_id").alias("in_id"), (F.least("a.high", "b.high") - F.greatest("a.low", "b.low")).alias("amount"), wait.alias("wait_s"))
