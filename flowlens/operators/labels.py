"""Label tables: competing sources, threats, look-ups, views of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIER_RANK = {"published_por": 4, "curated": 3, "explorer_tag": 2, "derived": 1}
CATEGORY_RANK = {"sanctioned": 7, "mixer": 6, "exchange": 5, "bridge": 4, "swap": 3, "defi": 2, "unknown": 1}


def rank_of(ranks: dict[str, int], column: str) -> Column:
    """The rank of a value, 0 for one not listed."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col(column)], F.lit(0))


def dedupe(labels: DataFrame) -> DataFrame:
    """One label per (address, chain): best tier, then category, then source, confidence and entity decide."""
    order = [rank_of(TIER_RANK, "tier").desc(), rank_of(CATEGORY_RANK, "category").desc(), F.col("source"), F.col("confidence").desc(), F.col("entity")]
    return labels.withColumn("n", F.row_number().over(W.partitionBy("address", "chain").orderBy(*order))).where("n = 1").drop("n")


def drop_conflicting(labels: DataFrame) -> DataFrame:
    """Without the keys that two or more entities claim."""
    key = W.partitionBy("address", "chain")
    return labels.withColumn("n", F.size(F.collect_set("entity").over(key))).where("n = 1").drop("n")


#: An address on one of these chains may also be labelled for all of them.
FAMILY_CHAINS, FAMILY = ["EUROPE", "ASIA"], "FAMILY"


def lookup(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """keys (address, chain) with the label of their own chain, or else of their chain family, or none."""
    own = F.struct(F.lit(0).alias("priority"), F.col("chain").alias("lchain"))
    both = F.when(F.col("chain").isin(FAMILY_CHAINS), F.array(own, F.struct(F.lit(1).alias("priority"), F.lit(FAMILY).alias("lchain")))).otherwise(F.array(own))
    wide = keys.select("address", "chain", F.inline(both)).join(labels.withColumnRenamed("chain", "lchain"), ["address", "lchain"])
    best = wide.groupBy("address", "chain").agg(F.min_by(F.struct("entity", "category", "tier"), "priority").alias("l"))
    return keys.join(best, ["address", "chain"], "left").select("address", "chain", "l.entity", "l.category", "l.tier")


def counts(labels: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n): one pass over grouping sets, one set a column."""
    stacked = labels.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])).alias("d"))
    return stacked.groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("n"))


THREAT_RANK = {"sanctions": 4, "terrorism": 3, "ransomware": 2, "scam": 1}


def merge_threats(tags: DataFrame) -> DataFrame:
    """One row per address of (address, threat, source, entity): the gravest tag, and the others as `source:threat`."""
    order = W.partitionBy("address").orderBy(rank_of(THREAT_RANK, "threat").desc(), "source", "entity", "threat")
    ranked = tags.withColumn("n", F.row_number().over(order))
    other = F.when(F.col("n") > 1, F.concat_ws(":", "source", "threat"))
    return ranked.groupBy("address").agg(
        F.max(F.when(F.col("n") == 1, F.col("threat"))).alias("threat"), F.max(F.when(F.col("n") == 1, F.col("source"))).alias("threat_source"),
        F.array_join(F.array_sort(F.collect_list(other)), ",").alias("threat_also"),
    )


def apply_threats(labels: DataFrame, threats: DataFrame) -> DataFrame:
    """Labels with their threat; threats on addresses without a label become labels of category `threat`."""
    tagged = labels.select("address", "entity", "category").join(threats.select("address", "threat"), "address", "full")
    return tagged.select(
        "address", F.coalesce("entity", F.lit("unknown")).alias("entity"),
        F.when(F.col("threat").isin("sanctions", "terrorism"), "sanctioned").otherwise(F.coalesce("category", F.lit("threat"))).alias("category"), "threat",
    )


def canonical_entity(name: Column, aliases: dict[str, str]) -> Column:
    """A name without deposit marks, numbering and signs, by alias where there is one, else with capitals."""
    owner = F.when(F.instr(name, " Dep:") > 0, F.substring_index(name, " Dep:", 1)).otherwise(name)
    slug = F.trim(F.regexp_replace(F.regexp_replace(F.lower(owner), "[^a-z0-9]+", " "), r"\s+[0-9]+$", ""))
    alias = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[slug]
    return F.coalesce(alias, F.initcap(slug))


def infer_kind(label: Column) -> Column:
    """What a wallet is used for, by the first pattern that its label has."""
    low = F.lower(label)
    return F.when(low.rlike("deposit|dep:"), "deposit").when(low.rlike("cold|vault"), "cold").when(low.rlike("hot|withdraw"), "hot").when(low.rlike("reserve"), "reserve").otherwise("unknown")


def tier_of(source: Column) -> Column:
    """The best tier among the `+`-joined parts of a source."""
    ranks = F.transform(F.split(source, r"\+"), lambda p: F.when(p.contains("registry"), 4).when(p.contains("tag"), 3).when(p.contains("crowd"), 2).when(p.contains("model"), 1).otherwise(0))
    return F.element_at(F.array(*map(F.lit, ["none", "derived", "explorer_tag", "curated", "published_por"])), F.array_max(ranks) + 1)


PROVIDERS = ["exchange", "swap"]


def seeds(labels: DataFrame) -> DataFrame:
    """Labels to start discovery from: of service providers, not derived, not deposit addresses."""
    return labels.where(F.col("category").isin(PROVIDERS) & (F.col("tier") != "derived") & (F.col("kind") != "deposit"))


def hidden(labels: DataFrame, keys: DataFrame) -> DataFrame:
    """Labels without those of keys (address)."""
    return labels.join(keys.select("address"), "address", "left_anti")


def search(labels: DataFrame, text: str, limit: int, offset: int) -> DataFrame:
    """One page of the labels whose address starts with the text or whose entity holds it, case aside."""
    hit = labels.where(F.col("address").ilike(f"{text}%") | F.col("entity").ilike(f"%{text}%"))
    return hit.orderBy("entity", "chain", "address", "source").offset(offset).limit(limit)


def tag_check(transfers: DataFrame, labels: DataFrame, tags: DataFrame) -> DataFrame:
    """Does the wallet's commonest recipient bear its tag? (address, tagged, top_to, n, verdict) for tags (address, tagged)."""
    sent = transfers.join(tags.select(F.col("address").alias("from_addr")), "from_addr", "left_semi").groupBy("from_addr", "to_addr").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("from_addr").orderBy(F.col("n").desc(), "to_addr")
    top = sent.withColumn("i", F.row_number().over(order)).where("i = 1").select(F.col("from_addr").alias("address"), F.col("to_addr").alias("top_to"), "n")
    named = top.join(labels.select(F.col("address").alias("top_to"), F.col("entity").alias("top_entity")), "top_to", "left")
    verdict = F.when(F.col("top_to").isNull(), "no_payments").when(F.col("top_entity").isNull(), "unlabelled").when(F.col("top_entity") == F.col("tagged"), "agrees").otherwise("differs")
    return tags.join(named, "address", "left").select("address", "tagged", "top_to", "n", verdict.alias("verdict"))
