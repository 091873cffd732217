"""Streams: windows over late events, frozen addresses as state, nonces once, watched snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlens.operators import views

FROZEN = "address string, since timestamp, released timestamp"
FROZEN_STATE = "since timestamp, seq long"


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, cents: counts and sums of each window, once the watermark has passed it."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(
        F.col("window.start").alias("start"), "event_type", "n", "cents"
    )


def sliding(events: DataFrame, span: str = "1 day", every: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """start, user_id, n_kinds over sliding windows."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", span, every), "user_id").agg(F.approx_count_distinct("event_type").alias("n_kinds"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "user_id", "n_kinds", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n: runs of events without a longer gap."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def claim_once(nonces: DataFrame, keep: str = "900 seconds") -> DataFrame:
    """Each nonce (nonce, ts) the first time; it is remembered for as long as the watermark keeps it."""
    return nonces.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["nonce"])


def frozen(events: DataFrame) -> DataFrame:
    """Changes of what is frozen, over (address, ts, seq, added): the state of an address is when it was first added
    since its last removal."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, seq = state.get if state.exists else (None, -1)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        released = None
        for ts, n, added in zip(rows["ts"], rows["seq"], rows["added"]):
            if n <= seq:
                continue
            seq = n
            if added:
                since = ts if since is None else since
            else:
                since, released = None, ts
        state.update((since, int(seq)))
        yield pd.DataFrame({"address": [key[0]], "since": [since], "released": [released]}).astype({"since": "datetime64[ns]", "released": "datetime64[ns]"})

    return events.groupBy("address").applyInPandasWithState(follow, FROZEN, FROZEN_STATE, "update", GroupStateTimeout.NoTimeout)


DUE = "id string, due timestamp"
DUE_STATE = "last timestamp"


def watch(entries: DataFrame, every_s: int, late: str = "10 minutes") -> DataFrame:
    """(id, due): when watched entries fall due, over (id, ts, watched): looked at, or no longer watched.

    An entry is due so long after it was last looked at, each time once, unless it isn't watched any more by then. Within
    a batch that is told by the next event; after it, by a timer of the entry's own, which fires when the watermark
    passes. So the result doesn't depend on how events fall into batches.
    """
    wait = pd.Timedelta(seconds=every_s)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0]) if state.exists else None
        found = []
        if state.hasTimedOut:
            found, last = [last + wait], None
        else:
            rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
            for ts, watched in zip(rows["ts"], rows["watched"]):
                if last is not None and ts >= last + wait:
                    found.append(last + wait)
                last = ts if watched else None
        if last is None:
            if state.exists:
                state.remove()
        elif (last + wait).value // 1_000_000 <= state.getCurrentWatermarkMs():
            found.append(last + wait)
            if state.exists:
                state.remove()
        else:
            state.update((last.to_pydatetime(),))
            state.setTimeoutTimestamp((last + wait).value // 1_000_000)
        yield pd.DataFrame({"id": [key[0]] * len(found), "due": pd.Series(found, dtype="datetime64[ns]")})

    timed = entries.withWatermark("ts", late)
    return timed.groupBy("id").applyInPandasWithState(follow, DUE, DUE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def by_batch(path: str):
    """A foreachBatch sink whose rows have the column batch: each batch is a folder that a repeated batch replaces, so a
    stream that fails and starts again leaves every row once."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")


def upsert_latest(batch: DataFrame, path: str, keys: list[str], order: list) -> None:
    """A foreachBatch sink: appends a batch's newest row of each key; views.latest over the path reads the table."""
    views.latest(batch, keys, order).write.mode("append").parquet(path)
