"""How models and rules are measured: draws, datasets, folds, metrics at a bar, claims with labels hidden, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.operators import metrics
from flowlens.operators.labels import canonical_entity

SEED = 26182
GRID = (0.30, 0.40, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80)


def lot(seed: int, *columns: str) -> Column:
    """A row's place in a random order that any engine can compute."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *columns).cast("binary"))


def draw(rows: DataFrame, group: str, key: str, per_group: int, n: int | None = None, seed: int = SEED) -> DataFrame:
    """At most per_group rows of each group, and n in all, by lot. Ranks within a group stop at the cap, so a large
    group is cut before its rows meet."""
    ranked = rows.withColumn("__i", F.row_number().over(W.partitionBy(group).orderBy(lot(seed, key)))).where(F.col("__i") <= per_group)
    drawn = ranked if n is None else ranked.orderBy(lot(seed + 1, key)).limit(n)
    return drawn.drop("__i")


def strata(rows: DataFrame, kinds: dict[str, Column], key: str, per_stratum: int, seed: int = SEED) -> DataFrame:
    """rows with `stratum`, the first whose condition they meet, and so many of each by lot."""
    name = F.coalesce(*[F.when(cond, F.lit(k)) for k, cond in kinds.items()])
    return draw(rows.withColumn("stratum", name).where("stratum is not null"), "stratum", key, per_stratum, seed=seed)


def assemble(payments: DataFrame, positives: DataFrame, known: DataFrame, per_group: int = 40, seed: int = SEED) -> DataFrame:
    """(address, y, group): deposit addresses (address, group), and customers who paid addresses of one group only.

    payments: from_addr, to_addr. known: addresses that are nobody's customer. So many customers of each group, by lot.
    """
    sent = payments.join(positives.select(F.col("address").alias("to_addr"), "group"), "to_addr")
    one = sent.groupBy(F.col("from_addr").alias("address")).agg(F.count_distinct("group").alias("n"), F.min("group").alias("group")).where("n = 1").drop("n")
    ordinary = one.join(known.select("address").unionByName(positives.select("address")).distinct(), "address", "left_anti")
    customers = draw(ordinary, "group", "address", per_group, seed=seed)
    return positives.select("address", F.lit(1).alias("y"), "group").unionByName(customers.select("address", F.lit(0).alias("y"), "group"))


def hide_group(rows: DataFrame, group: str, label: str = "label_entity", columns: tuple[str, ...] = ("to_label", "label_share")) -> DataFrame:
    """rows as they would be if one group's labels weren't known: what was told by its label is zero."""
    return rows.select(*[F.when(F.col(label) == group, F.lit(0).cast(t)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c, t in rows.dtypes])


def leave_one_out(rows: DataFrame, group: str, least: int = 20) -> DataFrame:
    """rows with `fold`: a group with so many positives is a fold of its own; all others are one, `rest`."""
    big = rows.groupBy(group).agg(F.sum("y").alias("__p")).where(F.col("__p") >= least).select(group, F.col(group).alias("fold"))
    return rows.join(big, group, "left").withColumn("fold", F.coalesce("fold", F.lit("rest")))


def at_bar(scored: DataFrame, bar: float, by: list[str] | None = None) -> DataFrame:
    """Counts and rates of scored rows (y, score) at a threshold, in one pass; by groups if given."""
    hit, yes = F.col("score") >= bar, F.col("y") == 1
    n = lambda cond: F.count_if(cond)
    tp, fp, fn, tn = n(hit & yes), n(hit & ~yes), n(~hit & yes), n(~hit & ~yes)
    per = scored.groupBy(*(by or [])).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), F.round(F.avg(F.pow(F.col("score") - F.col("y"), 2)), 8).alias("brier"))
    share = lambda a, b: F.round(F.try_divide(a, b), 6)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return per.select(
        "*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(fp, fp + tn).alias("false_rate"), share(2 * tp, 2 * tp + fp + fn).alias("f1"),
        share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp * tn - fp * fn, root).alias("mcc"),
    )


def orderings(scored: DataFrame, orders: dict[str, Column], ks: tuple[int, ...] = (10, 25, 50)) -> DataFrame:
    """ordering, pr_auc, p_at_k for each k: how well different scores put the positives first."""
    parts = []
    for name, score in orders.items():
        rows = scored.select("idx", "y", score.alias("score"))
        top = [metrics.precision_at(rows, [k]).select(F.col("precision").alias(f"p_at_{k}")) for k in ks]
        block = reduce(lambda a, b: a.join(F.broadcast(b)), [metrics.pr_auc(rows), *top])  # one row each
        parts.append(block.select(F.lit(name).alias("ordering"), "*"))
    return reduce(DataFrame.unionByName, parts)


def class_thresholds(scored: DataFrame, by: str, target: float = 0.05, delta: float = 0.05, least: int = 30, grid: tuple[float, ...] = GRID, never: tuple[str, ...] = ()) -> DataFrame:
    """by, n, threshold, n_answered, errors: of each class the lowest bar whose error rate is surely under the target.

    delta is shared by classes and by bars. A class with too few rows, or that may never be answered, has no threshold.
    scored: by, score, y (1 where right).
    """
    sizes = scored.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    n_classes = sizes.count()
    level = 1 - delta / (n_classes + 1) / len(grid)
    bars = scored.sparkSession.createDataFrame([(t,) for t in grid], "threshold double")
    at = F.lit(-1)
    for k, t in enumerate(grid):
        at = F.when(F.col("score") >= t, k).otherwise(at)
    cells = scored.groupBy(by, at.alias("cell")).agg(F.count(F.lit(1)).alias("c"), F.sum(1 - F.col("y")).alias("e"))
    met = cells.join(F.broadcast(bars.withColumn("k", F.array_position(F.array(*map(F.lit, grid)), F.col("threshold")) - 1)), F.col("cell") >= F.col("k"))
    rows = met.groupBy(by, "threshold").agg(F.sum("c").alias("n_answered"), F.sum("e").alias("errors"))
    passing = rows.where(metrics.upper_bound(F.col("errors"), F.col("n_answered"), level) <= target).groupBy(by).agg(F.min_by(F.struct("threshold", "n_answered", "errors"), "threshold").alias("t"))
    found = sizes.join(passing, by, "left")
    fine = (F.col("n") >= least) & ~F.col(by).isin(*never) if never else F.col("n") >= least
    return found.select(by, "n", F.when(fine, F.col("t.threshold")).alias("threshold"), F.when(fine, F.col("t.n_answered")).alias("n_answered"), F.when(fine, F.col("t.errors")).alias("errors"))


def prior_blocks(scored: DataFrame, old: float, priors: dict[str, float], bins: int = 10) -> DataFrame:
    """block, prior, mean, brier, ece of the scores as they are and moved to other priors."""
    parts = []
    for name, prior in {"before": old, **priors}.items():
        moved = scored.withColumn("score", F.col("score") if name == "before" else metrics.adjust_to_prior(F.col("score"), old, prior))
        ece = metrics.reliability(moved, bins).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("mean_y"))) / F.sum("n")).alias("ece"))
        block = moved.agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.avg(F.pow(F.col("score") - F.col("y"), 2)), 6).alias("brier"))
        parts.append(block.join(F.broadcast(ece)).select(F.lit(name).alias("block"), F.round(F.lit(prior), 6).alias("prior"), "mean", "brier", F.round("ece", 6).alias("ece")))
    return reduce(DataFrame.unionByName, parts)


def claims(full: DataFrame, hidden: DataFrame) -> DataFrame:
    """origin, entity, rank, hops, share, confidence, correct: what is claimed with some labels hidden, against what the
    whole labels show one hop away. Both are candidates."""
    known = full.where("hops = 1").select("origin", "entity", F.lit(True).alias("known"))
    return hidden.join(known, ["origin", "entity"], "left").select("origin", "entity", "rank", "hops", "share", "confidence", F.coalesce("known", F.lit(False)).alias("correct"))


def bar_grid(claimed: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """bar, answered, right, coverage, risk: the nearest claim at or over each bar, over all origins with a claim.

    A claim counts for the bars between its own confidence and that of the nearer ones, so each origin gives one row a
    bar that changes its answer, and no row meets all bars.
    """
    own = W.partitionBy("origin").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    rows = claimed.withColumn("nearer", F.coalesce(F.max("confidence").over(own), F.lit(-1.0))).where("confidence > nearer")
    bars = F.filter(F.array(*map(F.lit, grid)), lambda t: (t <= F.col("confidence")) & (t > F.col("nearer")))
    per = rows.select(F.explode(bars).alias("bar"), "correct").groupBy("bar").agg(F.count(F.lit(1)).alias("answered"), F.count_if("correct").alias("right"))
    total = claimed.select("origin").distinct().agg(F.count(F.lit(1)).alias("all"))
    return per.join(F.broadcast(total)).select("bar", "answered", "right", F.round(F.col("answered") / F.col("all"), 6).alias("coverage"), F.round(1 - F.col("right") / F.col("answered"), 6).alias("risk"))


#: So many flags are needed before a model may speak.
LEAST_FLAGGED = 30


def gate(scored: DataFrame, bar: float, fold: str, reference: float, least: int = LEAST_FLAGGED) -> DataFrame:
    """May a model speak? fold (null for all together), held_out, positives, flagged, wrong, error, found, upper, enough, passes.

    scored: held-out scores (y, score). It passes with so many flags at the bar, of which wrong ones are no more than the
    reference even at the upper end: the exact one-sided 95 % bound of their share.
    """
    flag, wrong = F.col("score") >= bar, (F.col("score") >= bar) & (F.col("y") == 0)
    per = scored.rollup(fold).agg(F.count(F.lit(1)).alias("held_out"), F.sum("y").alias("positives"), F.count_if(flag).alias("flagged"), F.count_if(wrong).alias("wrong"), F.grouping(fold).alias("whole"))
    rates = per.withColumns({
        "error": F.round(F.try_divide("wrong", "flagged"), 6), "found": F.round(F.try_divide(F.col("flagged") - F.col("wrong"), "positives"), 6),
        "upper": F.when(F.col("flagged") > 0, metrics.upper_bound(F.col("wrong"), F.greatest("flagged", F.lit(1)))), "enough": F.col("flagged") >= least,
    })
    passes = F.col("enough") & F.coalesce(F.col("upper") <= reference, F.lit(False))
    return rates.withColumn("passes", passes).select(F.when(F.col("whole") == 0, F.col(fold)).alias(fold), "held_out", "positives", "flagged", "wrong", "error", "found", "upper", "enough", "passes")


def leaks(rows: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """key, n: values of each key that lie in several splits; none should."""
    parts = [rows.groupBy(F.col(k).cast("string").alias("value")).agg(F.count_distinct(split).alias("s")).where("s > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("key"), "n") for k in keys]
    return reduce(DataFrame.unionByName, parts)


def holders(edges: DataFrame, named: DataFrame) -> DataFrame:
    """origin, wallet, received, held, passed: what came to wallets that nobody named, and what of it stayed."""
    got = edges.groupBy("origin", F.col("to_addr").alias("wallet")).agg(F.sum("traced").alias("received"))
    sent = edges.groupBy("origin", F.col("from_addr").alias("wallet")).agg(F.sum("traced").alias("passed"))
    rows = got.join(named.select(F.col("address").alias("wallet")), "wallet", "left_anti").join(sent, ["origin", "wallet"], "left")
    return rows.select("origin", "wallet", "received", F.greatest(F.lit(0), F.col("received") - F.coalesce("passed", F.lit(0))).alias("held"), F.coalesce("passed", F.lit(0)).alias("passed"))


def due(entries: DataFrame, now: Column, every_s: int) -> DataFrame:
    """Entries (id, checked) that wait longer than the interval, with their place; those never checked come first."""
    waited = entries.where(F.col("checked").isNull() | (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("checked").cast("timestamp")) >= every_s * 1_000_000))
    return waited.withColumn("never", F.col("checked").isNull())


#: Verdicts of a check that let a tag name its wallet.
LOADED = ("confirmed", "used")


def checked_tags(labels: DataFrame, checks: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """labels (address, label, entity, category, source) with verdict: what deposit tags (`<owner> Dep: ...`) become.

    A tag is unresolved where its label is filed as an entity of another name. If the check (address, verdict) of its
    address is one of LOADED, it is named after its owner (by its usual name, with aliases), as an exchange, by the
    checked tag. All else stays; verdict is null where nothing was unresolved, and `unchecked` without a check.
    """
    owner = F.when(F.instr("label", " Dep:") > 0, F.trim(F.substring_index("label", " Dep:", 1)))
    open_ = F.coalesce((owner != "") & (F.col("category") == "entity") & (F.lower(owner) != F.lower("entity")), F.lit(False))
    rows = labels.join(checks.select("address", F.col("verdict").alias("told")), "address", "left").withColumn("verdict", F.when(open_, F.coalesce("told", F.lit("unchecked"))))
    loaded = F.coalesce(F.col("verdict").isin(*LOADED), F.lit(False))
    pick = lambda new, old: F.when(loaded, new).otherwise(F.col(old)).alias(old)
    return rows.select("address", "label", pick(canonical_entity(owner, aliases) if aliases else owner, "entity"), pick(F.lit("exchange"), "category"), pick(F.lit("checked tag"), "source"), "verdict", loaded.alias("loaded"))


def digest_rows(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, sha256 of each row's columns in one canonical form: names in order, numbers to six places, null spelt out."""
    parts = []
    for c, kind in sorted(d for d in rows.dtypes if d[0] in columns):
        text = F.format_string("%.6f", F.col(c)) if kind in ("double", "float") else F.col(c).cast("string")
        parts.append(F.concat(F.lit(f"{c}="), F.coalesce(text, F.lit("null"))))
    return rows.select(key, F.sha2(F.concat_ws(";", *parts), 256).alias("sha256"))


def verified(recorded: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """key, check: same, changed, missing or new, of digests recorded and computed again."""
    both = recorded.withColumnRenamed("sha256", "was").join(again.withColumnRenamed("sha256", "now"), key, "full")
    check = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    return both.select(key, check.alias("check"))
