"""Payment graphs from transfers: edges, activity, members, counterparties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entity_edges(transfers: DataFrame) -> DataFrame:
    """src, dst, n_tx, value, first_ts, last_ts; payments to oneself and to nobody are no edges."""
    real = transfers.where("from_addr <> to_addr")
    return real.groupBy(F.col("from_addr").alias("src"), F.col("to_addr").alias("dst")).agg(
        F.count(F.lit(1)).alias("n_tx"), F.sum("amount").alias("value"), F.min("block_time").alias("first_ts"), F.max("block_time").alias("last_ts")
    )


def active_entities(edges: DataFrame, least: int = 2) -> DataFrame:
    """entity, n_out, n_in: those with at least `least` counterparties on both sides together."""
    sides = edges.select(F.col("src").alias("entity"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("entity"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    both = sides.groupBy("entity").agg(F.sum("o").cast("long").alias("n_out"), F.sum("i").cast("long").alias("n_in"))
    return both.where(F.col("n_out") + F.col("n_in") >= least)


def member_stats(transfers: DataFrame, members: DataFrame) -> DataFrame:
    """For each member (column address): what it sent to and got from other members."""
    inside = transfers.join(members.select(F.col("address").alias("from_addr")), "from_addr", "left_semi")
    inside = inside.join(members.select(F.col("address").alias("to_addr")), "to_addr", "left_semi").where("from_addr <> to_addr")
    moves = inside.select(F.col("from_addr").alias("address"), "amount", F.lit(True).alias("sent")).unionByName(
        inside.select(F.col("to_addr").alias("address"), "amount", F.lit(False).alias("sent"))
    )
    found = moves.groupBy("address").agg(
        F.count_if("sent").alias("n_sent"), F.count_if(~F.col("sent")).alias("n_got"),
        F.sum(F.when(F.col("sent"), F.col("amount"))).alias("sent"), F.sum(F.when(~F.col("sent"), F.col("amount"))).alias("got"),
    )
    return members.select("address").join(found, "address", "left").na.fill(0)


def counterparties(edges: DataFrame) -> DataFrame:
    """entity, n_counterparties_out, counterparty_hhi, n_counterparties_in, total_in.

    One pass over both sides. The index needs each counterparty's share of the total: sum(v^2) / sum(v)^2.
    """
    squared = F.col("value").cast("decimal(38,0)") * F.col("value").cast("decimal(19,0)")
    sides = edges.select(F.col("src").alias("entity"), "value", squared.alias("sq"), F.lit(True).alias("out")).unionByName(
        edges.select(F.col("dst").alias("entity"), "value", F.lit(None).cast("decimal(38,0)").alias("sq"), F.lit(False).alias("out"))
    )
    total = F.sum(F.when(F.col("out"), F.col("value")))
    return sides.groupBy("entity").agg(
        F.count_if("out").alias("n_counterparties_out"),
        F.round(F.sum("sq").cast("double") / F.nullif(total, F.lit(0)).cast("double") / total.cast("double"), 6).alias("counterparty_hhi"),
        F.count_if(~F.col("out")).alias("n_counterparties_in"),
        F.coalesce(F.sum(F.when(~F.col("out"), F.col("value"))), F.lit(0)).alias("total_in"),
    )
