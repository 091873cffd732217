"""Exact dedup by a content sort, in DataFrame operations alone.

Rows are range-partitioned by the leading characters of their normalised text, at splitters that Spark samples (so a
splitter is a few bytes, however long the texts); where one lead is crowded, its texts are dealt over ranges by hash.
Each partition is sorted externally by the whole text, and a window over that order compares each text with its
neighbour in full. A text that holds a large share of the rows or of the bytes would fall into one range; such texts are
found beforehand by a count of hashes (combined before its shuffle) and get a second sort key that spreads their rows
over many ranges. Each range then leaves one row per hot text, and only those few rows meet again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.llm.common import ascii_lower, written

#: A text is hot from this many rows on, and from this share of all rows or all bytes on; so at most 2 / HOT_SHARE texts
#: are hot, which bounds what is broadcast. The rows of a hot text are spread over this many ranges.
HOT_ROWS, HOT_SHARE, SPREAD = 64, 1e-5, 1024
#: Characters of a text that a splitter has.
LEAD = 32


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS, spread: int = SPREAD) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after lower-casing A-Z; null counts as empty. The row with the largest id stays.
    Defined cases: an empty table gives no rows; a null id is below all others, and keep_id is null only where all
    ids of a group are; of rows with the same text and the same largest id one stays, whichever comes first in
    Spark's order of the remaining ties; other columns of docs are not read.
    """
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("norm")).withColumn("h", F.xxhash64("norm"))
    n, n_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    sizes = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("norm")).alias("bytes"))
    often = (F.col("n") >= hot_rows) & ((F.col("n") >= n * HOT_SHARE) | (F.col("bytes") >= n_bytes * HOT_SHARE))
    hot = F.broadcast(written(sizes.where(often).select("h", F.lit(True).alias("hot")), "exact-hot"))
    # ids alone spread a hot text; xxhash64 so that ids in steps spread as well
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(spread))).otherwise(F.lit(0)).cast("int")
    dealt = rows.join(hot, "h", "left").select("doc_id", "norm", "h", F.substring("norm", 1, LEAD).alias("lead"), F.coalesce("hot", F.lit(False)).alias("hot"), salt.alias("salt"))
    # the window asks for rows clustered by these and norm, which the range partitioning already gives
    ranged = dealt.repartitionByRange("lead", "h", "salt")
    run = W.partitionBy("lead", "norm", "h", "salt")
    latest = run.orderBy(F.col("doc_id").desc_nulls_last())
    local = ranged.select(
        "doc_id", "hot", "salt",
        F.sha2("norm", 256).alias("text_sha256"),
        F.row_number().over(latest).alias("n"),
        F.first("doc_id").over(latest).alias("keep_id"),
        F.count(F.lit(1)).over(run).alias("group_size"),
    )
    return _joined_runs(written(local, "exact-runs"))


def _joined_runs(local: DataFrame) -> DataFrame:
    """Runs of one hot text, one for each range it was spread over, brought together.

    The heads of the runs (at most `spread` rows a hot text) meet by digest; cold texts have one run and pass by.
    """
    heads = local.where("hot and n = 1").select("text_sha256", "salt", "keep_id", "group_size")
    whole = heads.groupBy("text_sha256").agg(
        F.sum("group_size").alias("all_size"),
        F.max("keep_id").alias("all_keep"),
        # the run that holds the row to keep: the largest id, then the smallest salt
        F.max_by("salt", F.struct(F.col("keep_id").isNotNull(), "keep_id", -F.col("salt"))).alias("keep_salt"),
    )
    whole = written(whole, "exact-whole")
    cold = local.where("not hot").select("doc_id", "keep_id", "group_size", (F.col("n") == 1).alias("kept"), "text_sha256")
    spread = local.where("hot").drop("keep_id", "group_size").join(whole, "text_sha256").select(
        "doc_id", F.col("all_keep").alias("keep_id"), F.col("all_size").alias("group_size"),
        ((F.col("n") == 1) & (F.col("salt") == F.col("keep_salt"))).alias("kept"), "text_sha256",
    )
    return cold.unionByName(spread)
