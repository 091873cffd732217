"""The watcher: entries that fall due, over streams that come in pieces, fail and start again."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException

from flowlens.streaming import state

START, WAIT, LATE = datetime(2026, 1, 1), 3600, timedelta(minutes=10)


def drawn(n=200):
    draw = random.Random(3)
    at = sorted(START + timedelta(seconds=draw.randrange(2 * 86400)) for _ in range(n))
    return [(f"e{draw.randrange(15)}", ts, draw.random() < 0.85) for ts in at]


def plain(rows):
    """By looking at each event's next one, and at the end at how far the stream's time has come."""
    found, last = [], {}
    for name, ts, watched in rows:
        due = last.pop(name, None)
        if due is not None and ts >= due:
            found.append((name, due))
        if watched:
            last[name] = ts + timedelta(seconds=WAIT)
    end = max(ts for _, ts, _ in rows) - LATE
    return sorted(found + [(name, due) for name, due in last.items() if due <= end])


def drain(spark, source, out, checkpoint, fail_at=None):
    rows = spark.readStream.schema("id string, ts timestamp, watched boolean").option("maxFilesPerTrigger", 1).parquet(source)
    write = state.by_batch(out)

    def sink(batch, n):
        write(batch, n)
        if n == fail_at:
            raise RuntimeError("the machine is gone after the rows were written")

    state.watch(rows, WAIT).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


@pytest.mark.parametrize("pieces", [1, 4])
def test_due_entries_over_a_stream_that_fails(spark, tmp_path, pieces):
    rows = drawn()
    for k in range(pieces):
        part = rows[k * len(rows) // pieces : (k + 1) * len(rows) // pieces]
        spark.createDataFrame(part, "id string, ts timestamp, watched boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "source"))
    where = [str(tmp_path / name) for name in ("source", "out", "state")]
    with pytest.raises(StreamingQueryException):
        drain(spark, *where, fail_at=min(1, pieces - 1))
    drain(spark, *where)
    found = sorted((r.id, r.due) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == plain(rows) and len(found) > 50
