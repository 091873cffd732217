"""The trie of conversations' prefixes: which are shared, by whom, and what sharing them saves.

Each distinct sequence of first turns (role, text) is a node, and the conversations that begin with it are its members.
The smallest member owns a node. Whoever owns a node is also the smallest member of the node below it on its own path,
so each conversation owns a suffix of its path, which one number says: the depth from which it owns (`owned_from`). With
that, all of a node's sums come from one grouping of its members' rows. Below a node, each occurrence of a turn that its
conversation doesn't own is a repetition, so the tokens saved are the running sum, from the end of each path, of what
isn't owned. A conversation's last turn is a leaf if it owns it and nobody goes on. A child is counted by the member that
owns it.

Prefixes are told apart by 128 bits: the exclusive or of two hashes of (depth, SHA-256 of role and text) over a path.
Nothing gathers a group: places in a conversation come from a sorted layout that splits a long one, running values are
taken within SPAN turns of it and their totals added, copies are pre-aggregated before they meet, and the ids of those
that end at a node are hashed as a stream of sorted pieces.

Null roles and texts are empty, turns without a number come first, and turns of one number are ordered by role and text.
Repeated rows are turns of their own. Rows without a conversation's id belong to none. An empty table gives no nodes.
Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.llm.common import written

#: Turns of a conversation whose running values are taken together; ids that make one piece of what is hashed.
SPAN, PIECE = 1024, 4096
NODE = ["depth", "x", "y"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), digest (SHA-256 of role and text) and size (the text's code points) of each turn.

    Turns are laid out by range, so that a conversation of any length is dealt over partitions, and counted from the
    first of their partition; only those that cross a partition's end, at most two a partition, need an offset.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    laid = turns.repartitionByRange(*keys).sortWithinPartitions(*keys)
    digest = F.unhex(F.sha2(F.concat_ws(":", F.char_length("role").cast("string"), F.concat("role", "text")), 256))
    laid = written(laid.select("conv_id", F.monotonically_increasing_id().alias("seq"), digest.alias("digest"), F.char_length("text").cast("long").alias("size")), "turns")
    laid = laid.withColumn("part", F.shiftright("seq", 33))
    parts = laid.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    over = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a partition has at most one conversation that began in an earlier one
    offsets = parts.select("conv_id", "part", F.sum("n").over(over).alias("before")).where("before is not null")
    first = F.min("seq").over(Window.partitionBy("conv_id", "part"))
    placed = laid.withColumn("at", F.col("seq") - first + 1).join(F.broadcast(offsets), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("depth"), "digest", "size")


def crc(of: Column) -> Column:
    return F.crc32(of.cast("string").cast("binary"))


def rebuilt(turns: DataFrame, block: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: ids, and turns as of ordered_turns.

    Of each block of ids (c - c % block), c begins with the first h turns of the block's first conversation (as many as
    it has) and goes on with its own turns after its first h; h is crc32(c) % heads. Remainders have the sign of c, as SQL's
    have, so the ids from 1 - block to -1 share the beginning of 0.
    """
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    ids = ids.withColumns({"h": crc(F.col("conv_id")) % heads, "base": F.col("conv_id") - F.col("conv_id") % block})
    begun = turns.where((F.col("depth") < heads) & (F.col("conv_id") % block == 0)).withColumnRenamed("conv_id", "base")
    # at most `heads` turns of a base, for at most 2 * block conversations
    taken = ids.join(begun, "base").where(F.col("depth") <= F.col("h")).select("conv_id", "depth", "digest", "size")
    lengths = begun.groupBy("base").agg(F.max("depth").alias("has"))
    shift = ids.join(lengths, "base", "left").select("conv_id", "h", (F.least("h", F.coalesce("has", F.lit(0))) - F.col("h")).alias("shift"))
    rest = turns.join(shift, "conv_id").where(F.col("depth") > F.col("h")).withColumn("depth", F.col("depth") + F.col("shift"))
    return ids.select("conv_id"), taken.unionByName(rest.select("conv_id", "depth", "digest", "size"))


def prefixes(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each conversation and depth, from the root's 0 on: the prefix's hashes x and y, size, and last (its length).

    Hashes run within spans of SPAN turns; a span's totals, one row each, carry on into the next ones.
    """
    hashes = {c: F.xxhash64(F.lit(seed), "depth", "digest") for seed, c in enumerate("xy")}
    rows = turns.withColumns(hashes).withColumn("span", F.expr(f"depth div {SPAN}"))
    ends = rows.groupBy("conv_id", "span").agg(F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(y)").alias("y"), F.max("depth").alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "conv_id", "span", *(F.coalesce(F.expr(f"bit_xor({c})").over(earlier), F.lit(0)).alias(f"{c}0") for c in "xy"),
        F.max("last").over(Window.partitionBy("conv_id")).alias("last"),
    )
    running = Window.partitionBy("conv_id", "span").orderBy("depth")
    rows = rows.withColumns({c: F.expr(f"bit_xor({c})").over(running) for c in "xy"}).join(carried, ["conv_id", "span"])
    rows = rows.select("conv_id", "depth", *(F.col(c).bitwiseXOR(F.col(f"{c}0")).alias(c) for c in "xy"), "size", "last")
    zero = F.lit(0).cast("long")
    lengths = ids.join(ends.groupBy("conv_id").agg(F.max("last").alias("last")), "conv_id", "left")
    roots = lengths.select("conv_id", zero.alias("depth"), zero.alias("x"), zero.alias("y"), zero.alias("size"), F.coalesce("last", zero).alias("last"))
    return roots.unionByName(rows)


def trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children,
    n_leaves, saved_tokens (each node's (n_convs - 1) x code points of its last text, over its subtree), ends_sha256
    (of the ids that end there, ascending and joined by commas).
    """
    rows = written(prefixes(ids, turns), "prefixes")
    nodes = written(rows.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.max(F.col("last") > F.col("depth")).alias("more")), "nodes")
    owns = nodes.groupBy("owner").agg(F.min("depth").alias("owned_from"), F.max((~F.col("more")).cast("long")).alias("leaf"))
    rows = rows.join(owns.withColumnRenamed("owner", "conv_id"), "conv_id", "left")
    owned = F.coalesce(F.col("depth") >= F.col("owned_from"), F.lit(False))
    rows = rows.withColumns({"owned": owned, "repeated": F.when(owned, 0).otherwise(F.col("size")), "leaf": F.coalesce("leaf", F.lit(0))})
    below = F.col("owned_from").isNotNull() & (F.col("depth") + 1 >= F.col("owned_from")) & (F.col("depth") < F.col("last"))
    rows = rows.withColumns({"opens": below.cast("long"), "span": F.expr(f"depth div {SPAN}")})

    later = Window.partitionBy("conv_id").orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("conv_id", "span").agg(F.sum("repeated").alias("all"))
    spans = spans.select("conv_id", "span", F.coalesce(F.sum("all").over(later), F.lit(0)).alias("after"))
    running = Window.partitionBy("conv_id", "span").orderBy(F.col("depth").desc())
    rows = rows.withColumn("saves", F.sum("repeated").over(running)).join(spans, ["conv_id", "span"]).withColumn("saves", F.col("saves") + F.col("after"))

    # above what a conversation owns is somebody else's node: one row for each that owns any
    edge = rows.where(F.col("depth") == F.col("owned_from") - 1)
    above = edge.join(nodes, NODE).select("conv_id", F.col("owner").alias("above"))
    rows = rows.join(above, "conv_id", "left")
    parent = F.when(F.col("owned") & (F.col("depth") > 0), F.when(F.col("depth") > F.col("owned_from"), F.col("conv_id")).otherwise(F.col("above")))
    found = rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.max(parent).alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum("opens").alias("n_children"),
        F.sum("leaf").alias("n_leaves"), F.sum("saves").alias("saved_tokens"),
    )
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    found = found.join(ends(rows.where("depth = last")), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def ends(rows: DataFrame) -> DataFrame:
    """Of each node at which conversations end, SHA-256 of their ids; pieces of PIECE neighbouring ids are joined first."""
    pieces = rows.groupBy(*NODE, F.shiftright("conv_id", PIECE.bit_length() - 1).alias("piece")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select(*NODE, "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for batch in batches:
            out = []
            for *at, ids in zip(*(batch[c].tolist() for c in NODE), batch["ids"]):
                if at == node:
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = at, hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    return pieces.drop("piece").mapInPandas(hashed, "depth long, x long, y long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are: a row for each turn, with conv_id, turn, role and text."""
    turns = written(ordered_turns(conversations), "ordered-turns")
    return trie(turns.select("conv_id").distinct(), turns)
