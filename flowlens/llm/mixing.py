"""Mixing sources to target weights.

Each document gets a hash-random key, its place in a random order of its source. The key's leading digits are fixed
ranges of about equal size, so words are summed by (source, range) with a combine before the shuffle, prefix sums run
over a source's 4096 range totals, and only the one range of each source that its budget ends in is sorted row by row.
The cut found there (a key and a number of words) is one row per source, which decides every document's share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.llm.common import fresh, written

WEIGHTS, SHARE, CAP, DIGITS = (5, 2, 1), 1.5, 2, 3


def n_words(text: Column) -> Column:
    """Words as the rules of mixing count them; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_key(doc_id: Column) -> Column:
    """Uniform 32 hex digits, the same in every run; rows that share an id share a key."""
    return F.md5(F.concat(F.lit("mix-"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares of the budget by weight under a cap.

    Sources take the weights in turn, by code point and null last. A target stops at cap times its source; what that
    frees goes to the others by weight until none is above. Each round is one sum over the table of sources, and the
    driver sees three numbers of it.
    """
    # sources are ranked in ranges by their leading bytes, so that no task gets all of them
    lead = F.coalesce(F.substring("source", 1, 2), F.lit(""))
    rows = sizes.withColumn("part", F.struct(F.col("source").isNull(), lead))
    before = rows.groupBy("part").count()
    before = before.select(F.col("part"), F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy("source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = written(rows.join(before, "part").select("source", "source_size", weight.cast("long").alias("weight")), "mix-sources")
    most = F.col("source_size") * cap
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, n_capped = 0.0, -1
    while True:
        full = most < F.col("weight") * F.lit(level) if n_capped >= 0 else F.lit(False)
        found = rows.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, most)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        if found[0] == n_capped:
            break
        n_capped, level = found[0], (share * total - found[1]) / found[2] if found[2] else float("inf")
    capped = most < F.col("weight") * F.lit(level)
    return rows.select("source", "source_size", F.when(capped, most.cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def _cuts(slim: DataFrame, weights: tuple, share: float, cap: int) -> DataFrame:
    """One row per source: its size, its target, whole epochs, and where the last, partial one ends."""
    ranges = written(slim.groupBy("source", F.substring("key", 1, DIGITS).alias("range")).agg(F.sum("size").alias("words")), "mix-ranges")
    sources = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("budget", budget).withColumn("epochs", epochs)
    sources = written(sources.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")), "mix-targets")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    upto = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, 0)
    sums = ranges.withColumn("upto", F.sum("words").over(upto))
    hit = sums.alias("r").join(sources.alias("s"), same("r", "s")).where("upto - words <= rest and rest < upto")
    hit = hit.select("r.source", "range", (F.col("rest") - F.col("upto") + F.col("words")).alias("inside"))
    units = slim.withColumn("range", F.substring("key", 1, DIGITS)).alias("d").join(hit.alias("h"), same("d", "h") & F.expr("d.range = h.range"))
    units = units.groupBy("d.source", "inside", "key").agg(F.sum("size").alias("words"))
    upto = W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    cut = units.withColumn("upto", F.sum("words").over(upto)).where("upto - words <= inside and inside < upto")
    cut = cut.select("source", F.col("key").alias("cut_key"), (F.col("inside") - F.col("upto") + F.col("words")).alias("part"), F.col("words").alias("unit"))
    cut = written(cut, "mix-cuts")
    return written(sources.alias("s").join(cut.alias("c"), same("s", "c"), "left").select("s.source", "source_size", "target", "epochs", "cut_key", "part", "unit"), "mix-plan")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """docs, every row and column, with four columns more: size, source_size, target, taken (words the mix takes).

    A source's taken words sum to its rounded target exactly when its ids are unique; of the one document that the
    budget ends in, the first words are taken. Defined cases: null text has no words; a source without words has
    target 0; rows that share an id share a place in the order, and are cut in proportion where the budget ends in
    them; an empty table gives no rows; names that clash with the four get a leading underscore.
    """
    rows = docs.select(F.col(source_col).alias("source"), random_key(F.col(id_col)).alias("key"), n_words(F.col(text_col)).alias("size"))
    plan = _cuts(written(rows, "mix-rows"), weights, share, cap)
    return _taken(docs, plan, id_col, source_col, n_words(F.col(text_col)))


def _taken(docs: DataFrame, plan: DataFrame, id_col: str, source_col: str, size: Column) -> DataFrame:
    names = [fresh(docs, x) for x in ("size", "source_size", "target", "taken")]
    held, place = fresh(docs, "__plan"), fresh(docs, "__key")
    plan = plan.select(F.struct(*plan.columns).alias(held))
    rows = docs.withColumn(names[0], size).withColumn(place, random_key(F.col(id_col)))
    p, key, size = (lambda x: F.col(f"{held}.{x}")), F.col(place), F.col(names[0])
    joined = rows.join(plan, F.col(source_col).eqNullSafe(p("source")), "left")
    shared = F.expr(f"(`{names[0]}` * `{held}`.part) div `{held}`.unit")
    part = F.when(key < p("cut_key"), size).when(key == p("cut_key"), shared).otherwise(F.lit(0))
    taken = (p("epochs") * size + part).cast("long")
    return joined.select(*docs.columns, names[0], p("source_size").alias(names[1]), p("target").alias(names[2]), taken.alias(names[3]))
