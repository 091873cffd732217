"""Logs whose rows are chained by digests, so that a row that is changed, lost or moved shows.

A log is a column; its rows are numbered from 1. Rows are chained within segments of a fixed length. The last digests of
the segments are the rows of a log of heads, chained in the same way, and so on until one segment is left: no task
holds more than a segment, and the last head pins every row.
"""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.operators.ordered import running_sum
from flowlens.session import written

ROW = "log string, seq long, payload string, prev string, digest string"


def link(prev: str, payload: str, key: bytes = b"") -> str:
    """The digest of a row: HMAC-SHA256 under the key, or a plain SHA-256 without one."""
    text = (prev + payload).encode()
    return hmac.new(key, text, hashlib.sha256).hexdigest() if key else hashlib.sha256(text).hexdigest()


def genesis(log: Column, segment: Column) -> Column:
    """What the first row of a segment follows; a whole segment can't be passed off as another."""
    return F.sha2(F.concat(F.coalesce(log, F.lit("")), F.lit("|"), segment.cast("string")).cast("binary"), 256)


def _segment(step: int) -> Column:
    return F.expr(f"(seq - 1) div {step}")


def chained(rows: DataFrame, key: bytes = b"", step: int = 1000, last: DataFrame | None = None) -> DataFrame:
    """(log, seq, payload, prev, digest) over numbered rows (log, seq, payload); last: (log, seq, digest) of the rows
    that the first ones follow where those don't begin a segment."""
    begun = rows.withColumn("segment", _segment(step)).withColumn("prev", genesis(F.col("log"), F.col("segment")))
    if last is not None:
        open_ = last.select(F.col("log").alias("__log"), (F.col("seq") + 1).alias("__seq"), F.col("digest").alias("__digest")).where(f"(__seq - 1) % {step} <> 0")
        begun = begun.join(open_, F.col("log").eqNullSafe(F.col("__log")) & (F.col("seq") == F.col("__seq")), "left").withColumn("prev", F.coalesce("__digest", "prev"))

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        prev, before, digests = part["prev"].iloc[0], [], []
        for payload in part["payload"]:
            before.append(prev)
            prev = link(prev, payload or "", key)
            digests.append(prev)
        return part.assign(prev=before, digest=digests)[["log", "seq", "payload", "prev", "digest"]]

    return begun.select("log", "seq", "payload", "segment", "prev").groupBy("log", "segment").applyInPandas(follow, ROW)


def numbered(batch: DataFrame, order: list[str], starts: DataFrame, spans: int = 200) -> DataFrame:
    """(log, seq, payload) of a batch, in order behind each log's last number; a log that most rows are of is numbered by
    ranges of the first column of the order, from sampled splitters."""
    by = batch.repartitionByRange(spans, order[0]).withColumn("span", F.spark_partition_id())
    placed = running_sum(written(by, "log-batch").withColumn("log", F.coalesce("log", F.lit(""))), ["log"], "span", [F.col(c) for c in order], F.lit(1), "place")
    found = placed.join(starts.select("log", F.col("seq").alias("__start")), "log", "left")
    return found.select("log", (F.coalesce("__start", F.lit(0)) + F.col("place")).cast("long").alias("seq"), F.coalesce("payload", F.lit("")).alias("payload"))


def ends(rows: DataFrame) -> DataFrame:
    """(log, seq, digest) of each log's last row."""
    return rows.groupBy("log").agg(F.max("seq").alias("seq"), F.max_by("digest", "seq").alias("digest"))


def append(kept: DataFrame | None, batch: DataFrame, order: list[str], key: bytes = b"", step: int = 1000) -> DataFrame:
    """The rows (log, seq, payload, prev, digest) that a batch (log, payload and the columns of its order) adds to those
    that are kept; only those of the batch are made. A null log or payload counts as empty. The order should be total:
    rows that tie in it may be chained either way."""
    last = batch.sparkSession.createDataFrame([], "log string, seq long, digest string") if kept is None else written(ends(kept), "log-ends")
    return chained(written(numbered(batch, order, last), "log-rows"), key, step, last)


def _in_one(rows: DataFrame, key: bytes) -> DataFrame:
    """(log, seq, digest) of each log's last row, chained without segments: a log's rows pass a task in order, one batch at a time."""

    def follow(batches):
        log = seq = prev = None
        for batch in batches:
            done = []
            for name, at, payload, begin in zip(batch["log"], batch["seq"], batch["payload"], batch["prev"]):
                if name != log:
                    if log is not None:
                        done.append((log, seq, prev))
                    log, prev = name, begin
                seq, prev = at, link(prev, payload or "", key)
            yield pd.DataFrame(done, columns=["log", "seq", "digest"])
        if log is not None:
            yield pd.DataFrame([(log, seq, prev)], columns=["log", "seq", "digest"])

    begun = rows.select("log", "seq", "payload", genesis(F.col("log"), F.lit(0)).alias("prev"))
    return begun.repartition("log").sortWithinPartitions("log", "seq").mapInPandas(follow, "log string, seq long, digest string")


def heads(rows: DataFrame, key: bytes = b"", step: int = 1000, most: int | None = None) -> DataFrame:
    """(log, rows, levels, head): one digest that pins all rows of a log, to be noted elsewhere.

    Each level chains the last digests of the level's segments below; a level has 1 / step of the rows of the one below.
    most: so many levels at most, of which the last is chained in one, however long: with 2, of 1 / step of the rows."""
    level, levels = rows.select("log", "seq", "digest"), 1
    counts = rows.groupBy("log").agg(F.max("seq").alias("rows"))
    while (most is None or levels < most) and level.where(F.col("seq") > step).limit(1).count():
        segments = level.groupBy("log", _segment(step).alias("segment")).agg(F.max_by("digest", "seq").alias("payload"))
        above = segments.select("log", (F.col("segment") + 1).alias("seq"), "payload")
        levels += 1
        level = written(_in_one(above, key) if levels == most else chained(above, key, step), "log-heads").select("log", "seq", "digest")
    return ends(level).join(counts, "log").select("log", "rows", F.lit(levels).cast("long").alias("levels"), F.col("digest").alias("head"))


def breaks(rows: DataFrame, key: bytes = b"", step: int = 1000, noted: DataFrame | None = None) -> DataFrame:
    """(log, seq, reason) of every row that doesn't fit: `missing` (rows before it are gone; seq of the first one), `moved`
    (it doesn't follow the row before it), `changed` (its digest isn't that of what it says), `repeated`.

    Rows are looked at side by side, each with the one before it in its segment. noted: (log, rows) of heads that were
    noted; logs that end before are `missing` from their end on, which the rows alone can't tell.
    """

    def relink(prev: pd.Series, payload: pd.Series) -> pd.Series:
        return pd.Series([link(a or "", b or "", key) for a, b in zip(prev, payload)], dtype="object")

    order = W.partitionBy("log", "segment").orderBy("seq", "digest")
    seen = rows.withColumn("segment", _segment(step)).select("*", F.lag("seq").over(order).alias("__seq"), F.lag("digest").over(order).alias("__digest"))
    first = F.col("__seq").isNull()
    due = F.when(first, F.col("segment") * step + 1).otherwise(F.col("__seq") + 1)
    follows = F.when(first, genesis(F.col("log"), F.col("segment"))).otherwise(F.col("__digest"))
    reason = (
        F.when(F.col("seq") < due, "repeated")
        .when(F.col("seq") > due, "missing")
        .when(~F.col("prev").eqNullSafe(follows), "moved")
        .when(~F.col("digest").eqNullSafe(F.pandas_udf(relink, "string")("prev", "payload")), "changed")
    )
    found = seen.select("log", F.when(reason == "missing", due).otherwise(F.col("seq")).alias("seq"), reason.alias("reason")).where("reason is not null")
    # what a segment lacks at its end: all but a log's last one are full
    tails = rows.groupBy("log", _segment(step).alias("segment")).agg(F.max("seq").alias("seq"))
    after = W.partitionBy("log").orderBy("segment")
    last = F.col("__next").isNull()
    tails = tails.withColumn("__next", F.lead("segment").over(after))
    cut_off = tails.where(~last & ((F.col("seq") < (F.col("segment") + 1) * step) | (F.col("__next") > F.col("segment") + 1)))
    begin = rows.groupBy("log").agg(F.min("seq").alias("seq")).where(F.col("seq") > step).select("log", F.lit(1).cast("long").alias("seq"))
    gone = cut_off.select("log", (F.col("seq") + 1).alias("seq")).unionByName(begin)
    if noted is not None:
        known = rows.groupBy("log").agg(F.max("seq").alias("seq"))
        short = noted.join(known, "log", "left").where(F.coalesce("seq", F.lit(0)) < F.col("rows"))
        gone = gone.unionByName(short.select("log", (F.coalesce("seq", F.lit(0)) + 1).alias("seq")))
    return found.unionByName(gone.withColumn("reason", F.lit("missing"))).distinct()


def listed(rows: DataFrame, log: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """(total, place, log, seq, payload): a page of the newest rows, with how many there are."""
    wanted = rows if log is None else rows.where(F.col("log") == log)
    page = wanted.select("log", "seq", "payload").orderBy(F.col("seq").desc(), "log").offset(offset).limit(limit)
    total = wanted.agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(W.orderBy(F.col("seq").desc(), "log")) + offset
    return page.withColumn("place", place.cast("long")).join(total).select("total", "place", "log", "seq", "payload")
