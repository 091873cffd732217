"""What a trace says about its origin: risk by its indicators, why nobody is named, where the money stopped, what to do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.operators import typologies
from flowlens.operators.flow import FULL_SHARE, NAMED_FROM, TIER_WEIGHT
from flowlens.session import cut

# An indicator's points and what its share of the money adds, less by distance; the patterns.
POINTS = {
    "sanctioned_self": (100, 0), "sanctioned_contact": (75, 25), "sanctioned_funding": (55, 15), "mixer_self": (90, 0), "mixer_contact": (75, 15), "mixer_funding": (50, 15),
    "bridge_hop": (15, 15), "swap_service": (15, 0), "peel_chain": (20, 0), "fan_out": (10, 0), "fan_in": (5, 0), "round_amounts": (5, 0), "unlabelled_hub": (15, 0),
    "threat_self": (95, 0), "threat_contact": (75, 20), "threat_funding": (55, 15), "scam_self": (85, 0), "scam_contact": (60, 0), "coinjoin_shape": (40, 0),
    "frozen_self": (60, 0), "frozen_contact": (35, 10), "frozen_funding": (25, 10),
}
DISTANCE = (1.0, 0.8, 0.6)
PATTERNS = ("peel_chain", "fan_out", "fan_in", "round_amounts")
HUB_SHARE, MERGE, PEEL_SHARE, ROUND_UNIT, ROUND_LEAST, ROUND_SHARE = 0.5, 3, 0.70, 10_000, 3, 0.5


def _map(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def points(code: Column, share: Column, hops: Column) -> Column:
    """Points of an indicator; what is added for the share is rounded half to even."""
    far = F.when(hops <= 1, DISTANCE[0]).when(hops == 2, DISTANCE[1]).otherwise(DISTANCE[2])
    inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))
    added = F.bround(_map({k: v[1] for k, v in POINTS.items()}, code) * inside * far).cast("int")
    return F.least(F.lit(100), _map({k: v[0] for k, v in POINTS.items()}, code) + added)


def _totals(edges: DataFrame) -> DataFrame:
    return edges.where("hop = 1").groupBy("origin").agg(F.sum("traced").alias("total"))


def contacts(out: DataFrame, into: DataFrame, labels: DataFrame) -> DataFrame:
    """(origin, code, wallet, share, hops): labelled wallets that the money came to or from, and the origin's own label.

    A wallet on both sides is a contact. Only the mixers and the sanctioned count behind the origin.
    """
    kind = labels.where("category in ('sanctioned', 'mixer', 'bridge', 'swap')").select(F.col("address").alias("wallet"), "category")
    per = lambda e, end: e.groupBy("origin", F.col(end).alias("wallet")).agg(F.sum("traced").alias("amount"), F.min("hop").alias("hops")).join(kind, "wallet").join(_totals(e), "origin").withColumn("share", F.col("amount") / F.col("total"))
    met = per(out, "to_addr")
    name = F.when(F.col("category") == "bridge", "bridge_hop").when(F.col("category") == "swap", "swap_service").otherwise(F.concat("category", F.lit("_contact")))
    behind = per(into, "from_addr").where("category in ('sanctioned', 'mixer')").join(met.select("origin", "wallet"), ["origin", "wallet"], "left_anti")
    own = out.select("origin").distinct().join(kind.withColumnRenamed("wallet", "origin"), "origin").where("category in ('sanctioned', 'mixer')")
    parts = [
        met.select("origin", name.alias("code"), "wallet", "share", "hops"),
        behind.select("origin", F.concat("category", F.lit("_funding")).alias("code"), "wallet", "share", F.lit(1).alias("hops")),
        own.select("origin", F.concat("category", F.lit("_self")).alias("code"), F.col("origin").alias("wallet"), F.lit(0.0).alias("share"), F.lit(1).alias("hops")),
    ]
    return reduce(DataFrame.unionByName, parts)


def on_lists(out: DataFrame, into: DataFrame, labels: DataFrame, threats: DataFrame, scams: DataFrame) -> DataFrame:
    """(origin, code, wallet, share, hops): wallets with a threat tag, or on a scam list, that a trace meets or starts from.

    threats, scams: address. What is labelled as sanctioned or a mixer counts as that alone, and what has a threat tag
    isn't looked for on scam lists. A tagged wallet on both sides is a contact; a scam list tells no side.
    """
    named = lambda df: df.select(F.col("address").alias("wallet")).distinct()
    tagged = named(threats).join(named(labels.where("category in ('sanctioned', 'mixer')")), "wallet", "left_anti")
    listed = named(scams).join(named(threats), "wallet", "left_anti")
    share = F.col("amount") / F.col("total")
    per = lambda e, end: e.groupBy("origin", F.col(end).alias("wallet")).agg(F.sum("traced").alias("amount"), F.min("hop").alias("hops")).where("wallet <> origin")
    met, behind = per(out, "to_addr"), per(into, "from_addr")
    contact = met.join(tagged, "wallet").join(_totals(out), "origin").select("origin", F.lit("threat_contact").alias("code"), "wallet", share.alias("share"), "hops")
    only = behind.join(tagged, "wallet").join(met.select("origin", "wallet"), ["origin", "wallet"], "left_anti")
    funding = only.join(_totals(into), "origin").select("origin", F.lit("threat_funding").alias("code"), "wallet", share.alias("share"), F.lit(1).alias("hops"))
    alone = lambda rows, code: rows.select("origin", F.lit(code).alias("code"), "wallet", F.lit(0.0).alias("share"), F.lit(1).alias("hops"))
    own = out.select("origin", F.col("origin").alias("wallet")).distinct()
    both = met.select("origin", "wallet").unionByName(behind.select("origin", "wallet")).distinct()
    parts = [contact, funding, alone(own.join(tagged, "wallet"), "threat_self"), alone(own.join(listed, "wallet"), "scam_self"), alone(both.join(listed, "wallet"), "scam_contact")]
    return reduce(DataFrame.unionByName, parts)


def patterns(out: DataFrame, into: DataFrame) -> DataFrame:
    """(origin, code, wallet): wallets of a trace that fan out, merge, peel in a row; origins with many funders or round sums."""
    pair = F.concat_ws(">", "origin", "from_addr")
    # so many in 24 hours are half as many payments at least in one of two days: the others' payments aren't laid out
    day = F.floor(F.unix_micros(F.col("block_time").cast("timestamp")) / (24 * 3600 * 1_000_000)).alias("day")
    crowded = out.groupBy("origin", "from_addr", day).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * 2 >= typologies.FAN_OUT)
    some = out.join(cut(crowded.select("origin", "from_addr").distinct()), ["origin", "from_addr"], "left_semi")
    fans = typologies.fan_out(some.select(pair.alias("sender"), F.col("block_time").alias("ts"), "to_addr")).where(F.col("most") >= typologies.FAN_OUT)
    fans = fans.select(F.substring_index("sender", ">", 1).alias("origin"), F.lit("fan_out").alias("code"), F.substring_index("sender", ">", -1).alias("wallet"))
    funders = into.where("hop = 1").groupBy("origin").agg(F.count_distinct("from_addr").alias("n")).where(F.col("n") >= typologies.FAN_IN).select("origin", F.lit("fan_in").alias("code"), F.col("origin").alias("wallet"))
    merged = out.where("from_addr <> origin and to_addr <> origin").groupBy("origin", F.col("to_addr").alias("wallet")).agg(F.count_distinct("from_addr").alias("n")).where(F.col("n") >= MERGE).select("origin", F.lit("fan_in").alias("code"), "wallet")
    first = out.where("hop = 1 and asset <> 'COIN'").groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("amount") >= ROUND_UNIT) & (F.col("amount") % ROUND_UNIT == 0)).alias("n_round"))
    rounds = first.where((F.col("n_round") >= ROUND_LEAST) & (F.col("n_round") >= ROUND_SHARE * F.col("n"))).select("origin", F.lit("round_amounts").alias("code"), F.col("origin").alias("wallet"))
    got = out.groupBy("origin", F.col("to_addr").alias("wallet")).agg(F.sum("traced").alias("got"))
    sent = out.groupBy("origin", F.col("from_addr").alias("wallet"), "to_addr").agg(F.sum("traced").alias("v"))
    main = sent.groupBy("origin", "wallet").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v"), F.max_by("to_addr", F.struct("v", "to_addr")).alias("main"))
    peels = cut(main.join(got, ["origin", "wallet"]).where((F.col("n") >= 2) & (F.col("v") >= PEEL_SHARE * F.col("got")) & (F.col("wallet") != F.col("origin"))).select("origin", "wallet", "main"))
    chain = peels.join(peels.select("origin", F.col("wallet").alias("main")), ["origin", "main"], "left_semi").select("origin", F.lit("peel_chain").alias("code"), "wallet")
    return reduce(DataFrame.unionByName, [fans, funders, merged, rounds, chain])


def indicators(out: DataFrame, into: DataFrame, holds: DataFrame, labels: DataFrame, frozen: DataFrame, threats: DataFrame | None = None, scams: DataFrame | None = None) -> DataFrame:
    """(origin, code, wallet, points, is_pattern): all that speaks against an origin.

    out, into: edges of its traces in both directions. holds: where the first stopped; what entered a mix of many parties
    is a `coinjoin_shape`. frozen, threats, scams: address.
    """
    ice = frozen.select(F.col("address").alias("wallet")).distinct()
    side = lambda e, end: e.groupBy("origin", F.col(end).alias("wallet")).agg(F.sum("traced").alias("amount"), F.min("hop").alias("hops")).join(ice, "wallet").join(_totals(e), "origin")
    cold = side(out, "to_addr").select("origin", F.lit("frozen_contact").alias("code"), "wallet", (F.col("amount") / F.col("total")).alias("share"), "hops")
    cold = cold.unionByName(side(into, "from_addr").select("origin", F.lit("frozen_funding").alias("code"), "wallet", (F.col("amount") / F.col("total")).alias("share"), "hops"))
    cold = cold.where("wallet <> origin").unionByName(out.select("origin").distinct().join(ice.withColumnRenamed("wallet", "origin"), "origin").select("origin", F.lit("frozen_self").alias("code"), F.col("origin").alias("wallet"), F.lit(0.0).alias("share"), F.lit(1).alias("hops")))
    hub = holds.where("reason = 'hub'").groupBy("origin").agg(F.sum("held").alias("held")).join(_totals(out), "origin").where(F.col("held") >= HUB_SHARE * F.col("total"))
    mixed = holds.where("reason = 'coinjoin' and held > 0").select("origin", F.lit("coinjoin_shape").alias("code"), "wallet").distinct()
    plain = patterns(out, into).unionByName(mixed).unionByName(hub.select("origin", F.lit("unlabelled_hub").alias("code"), F.lit(None).cast("string").alias("wallet")))
    rows = contacts(out, into, labels).unionByName(cold).unionByName(plain.withColumn("share", F.lit(0.0)).withColumn("hops", F.lit(1)))
    nobody = labels.select("address").limit(0)
    if threats is not None or scams is not None:
        rows = rows.unionByName(on_lists(out, into, labels, nobody if threats is None else threats, nobody if scams is None else scams))
    return rows.select("origin", "code", "wallet", points(F.col("code"), F.col("share"), F.col("hops")).alias("points"), F.col("code").isin(*PATTERNS).alias("is_pattern"))


def merged(found: DataFrame) -> DataFrame:
    """(origin, code, points, is_pattern, wallet, n): the largest instance of each kind, and how many there are."""
    order = F.struct(-F.col("points"), F.coalesce("wallet", F.lit("")))
    return found.groupBy("origin", "code").agg(F.max("points").alias("points"), F.max("is_pattern").alias("is_pattern"), F.min_by("wallet", order).alias("wallet"), F.count(F.lit(1)).alias("n"))


def case_risk(found: DataFrame) -> DataFrame:
    """origin, score, class, n_indicators."""
    rows = merged(found)
    score = typologies.risk_total(rows.drop("wallet", "n").withColumnRenamed("origin", "wallet"))
    return score.withColumnRenamed("wallet", "origin").join(rows.groupBy("origin").agg(F.count(F.lit(1)).alias("n_indicators")), "origin")


def wallet_risk(labels: DataFrame, frozen: DataFrame, cases: DataFrame, threats: DataFrame | None = None, scams: DataFrame | None = None) -> DataFrame:
    """wallet, score, class over a wallet's own label, its freeze, what lists say of it and its own case (origin, code,
    points, is_pattern)."""
    own = labels.where("category in ('sanctioned', 'mixer')").select(F.col("address").alias("wallet"), F.concat("category", F.lit("_self")).alias("code"))
    own = own.unionByName(frozen.select(F.col("address").alias("wallet"), F.lit("frozen_self").alias("code")).distinct())
    grave = labels.where("category in ('sanctioned', 'mixer')").select("address")
    for lists, code, counted in ((threats, "threat_self", grave), (scams, "scam_self", threats)):
        if lists is not None:
            new = lists.select("address").distinct() if counted is None else lists.select("address").distinct().join(counted.select("address"), "address", "left_anti")
            own = own.unionByName(new.select(F.col("address").alias("wallet"), F.lit(code).alias("code")))
    rows = own.select("wallet", "code", points(F.col("code"), F.lit(0.0), F.lit(1)).alias("points"), F.lit(False).alias("is_pattern"))
    rows = rows.unionByName(cases.select(F.col("origin").alias("wallet"), "code", "points", "is_pattern"))
    return typologies.risk_total(rows.groupBy("wallet", "code").agg(F.max("points").alias("points"), F.max("is_pattern").alias("is_pattern")))


def self_candidates(origins: DataFrame, labels: DataFrame) -> DataFrame:
    """origin, entity, confidence: origins that are a service's own wallets."""
    own = labels.where(F.col("category").isin("exchange", "swap")).select(F.col("address").alias("origin"), "entity", _map(TIER_WEIGHT, F.col("tier")).alias("confidence"))
    return origins.join(own, "origin")


#: Why money stops, in words; the weightier first.
STOPPED = {
    "labelled": "came to a known service", "kept": "stayed where it was", "truncated": "moved on beyond what was read", "depth_limit": "went further than was followed",
    "hub": "came to a wallet with very many counterparties", "small": "was split into parts too small to follow", "budget": "came to more wallets than were followed", "origin": "came back",
}


def whole_percent(share: Column) -> Column:
    return F.floor(share * 100 + 0.5).cast("long")


def where_it_stopped(holds: DataFrame) -> DataFrame:
    """origin, reason, share, text, hints: what became of the money, with the two wallets that hold most for each reason."""
    held = holds.where("held > 0")
    own = W.partitionBy("origin", "reason").orderBy(F.col("held").desc(), "wallet")
    per = held.groupBy("origin", "reason", "wallet").agg(F.sum("held").alias("held"))
    top = per.withColumn("i", F.row_number().over(own)).where("i <= 2").groupBy("origin", "reason").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "wallet"))), lambda x: x.wallet), ", ").alias("hints"))
    sums = held.groupBy("origin", "reason").agg(F.sum("held").alias("held")).withColumn("share", F.col("held") / F.sum("held").over(W.partitionBy("origin")))
    text = F.concat(whole_percent(F.col("share")).cast("string"), F.lit("% of the money "), _map(STOPPED, F.col("reason")))
    return sums.join(top, ["origin", "reason"]).select("origin", "reason", F.round("share", 6).alias("share"), text.alias("text"), "hints")


def abstained(outcomes: DataFrame, candidates: DataFrame, stops: DataFrame) -> DataFrame:
    """origin, why, text, step: for origins where nobody is named, why, and what to do next.

    No service was reached; or the nearest is too far, or its share too small, for its confidence to reach the bar.
    """
    none = outcomes.where("outcome = 'INSUFFICIENT_EVIDENCE'").select("origin")
    best = candidates.groupBy("origin").agg(F.max_by(F.struct("entity", "hops", "share", "confidence"), F.struct("confidence", -F.col("rank"))).alias("b"))
    most = stops.where("reason <> 'labelled'").groupBy("origin").agg(F.max_by("reason", F.struct("share", "reason")).alias("reason"))
    rows = none.join(best, "origin", "left").join(most, "origin", "left")
    why = F.when(F.col("b").isNull(), "no_service").when(F.col("b.share") < FULL_SHARE * NAMED_FROM, "small_share").otherwise("weak_evidence")
    text = (
        F.when(why == "no_service", "The money was not seen to reach a service.")
        .when(why == "small_share", F.concat(F.lit("Only "), whole_percent(F.col("b.share")).cast("string"), F.lit("% of the money reached "), F.col("b.entity"), F.lit(".")))
        .otherwise(F.concat(F.lit("The evidence for "), F.col("b.entity"), F.lit(" is "), whole_percent(F.col("b.confidence")).cast("string"), F.lit("%, under the bar.")))
    )
    steps = {"depth_limit": "Trace further.", "hub": "Ask who runs the busy wallet.", "kept": "Watch the wallets that hold the money.", "small": "Lower the least share.", "budget": "Follow more wallets.", "truncated": "Read more payments.", "origin": "Trace again from a later date."}
    return rows.select("origin", why.alias("why"), text.alias("text"), F.coalesce(_map(steps, F.col("reason")), F.lit("Look for more payments.")).alias("step"))


#: Why traced money stopped without the trace having seen where it went.
BLIND = ("depth_limit", "budget", "truncated", "small", "pooled", "coinjoin")


def verdicts(counter: DataFrame, before: DataFrame, after: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """origin, entity, address, was, now, verdict: what hiding the label where a named service's money came in leaves.

    `holds` where the same service is still named at the bar, `weaker` where it is reached below the bar, `gone` where it
    isn't reached, and `not_checked` where it isn't and more money than before stopped unseen. counter: origin, entity and
    the address whose label is hidden; before, after: candidates; first, second: holds of the two traces.
    """
    was = before.join(counter.select("origin", "entity", "address"), ["origin", "entity"]).select("origin", "entity", "address", F.col("confidence").alias("was"))
    unseen = lambda h, name: h.where(F.col("reason").isin(*BLIND)).groupBy("origin", "reason").agg(F.sum("held").alias(name))
    more = unseen(second, "later").join(unseen(first, "sooner"), ["origin", "reason"], "left").where(F.col("later") > F.coalesce("sooner", F.lit(0)))
    now = after.select("origin", "entity", F.col("confidence").alias("now"))
    rows = was.join(now, ["origin", "entity"], "left").join(more.select("origin", F.lit(True).alias("blind")).distinct(), "origin", "left")
    verdict = F.when(F.col("now") >= NAMED_FROM, "holds").when(F.col("now").isNotNull(), "weaker").when(F.col("blind"), "not_checked").otherwise("gone")
    return rows.select("origin", "entity", "address", "was", "now", verdict.alias("verdict"))


def bridge_steps(out: DataFrame, labels: DataFrame) -> DataFrame:
    """origin, entity, text: what to ask each bridge that the money came to."""
    at = labels.where("category = 'bridge'").select(F.col("address").alias("to_addr"), "entity")
    per = out.join(at, "to_addr").groupBy("origin", "entity").agg(F.count_distinct("tx_hash").alias("n"))
    return per.select("origin", "entity", F.concat(F.lit("Ask "), "entity", F.lit(" where "), F.col("n").cast("string"), F.when(F.col("n") == 1, " deposit was paid out.").otherwise(" deposits were paid out.")).alias("text"))


def crossing_words(legs: DataFrame) -> DataFrame:
    """tx_hash, text of crossings (tx_hash, status, reason, to_chain, recipient)."""
    followed = F.concat(F.lit("crossed to "), F.col("to_chain"), F.lit(", paid to "), F.col("recipient"))
    other = F.when(F.col("reason") == "no_match", "the bridge names no payout").when(F.col("reason") == "no_payout", "the payout was not found").otherwise(F.col("reason"))
    return legs.select("tx_hash", F.when(F.col("status") == "followed", followed).otherwise(F.concat(F.lit("not followed: "), other)).alias("text"))


def model_items(labels: DataFrame, model: str = "model") -> DataFrame:
    """address, p, reason, effect: a model label's evidence, one row a reason, out of its JSON."""
    parsed = F.from_json(model, "p double, reasons array<struct<name string, effect double>>").alias("m")
    return labels.where(F.col(model).isNotNull()).select("address", parsed).select("address", "m.p", F.explode("m.reasons").alias("r")).select("address", "p", F.col("r.name").alias("reason"), F.col("r.effect").alias("effect"))
