"""Streams: micro-batches written as engine batches, and keys that expire unless they are written again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.sources.store import Engine


def ingest(stream: DataFrame, engine: Engine, checkpoint: str, available_now: bool = True, interval: str = "1 second") -> StreamingQuery:
    """Writes a stream of rows (key, value, op, pos, expires_at) into an engine, a micro-batch a batch. A micro-batch that Spark runs
    again after a failure is known by its stream's checkpoint and its number, and not written twice."""

    def write(batch: DataFrame, number: int) -> None:
        if number > engine.streamed(checkpoint) and not batch.isEmpty():
            engine.append(batch, streams={checkpoint: number})

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def with_event_time(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """ts as a timestamp with a watermark: rows later than that are dropped by stateful operators."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def expirations(stream: DataFrame, key: str, ts: str, ttl_seconds: int, late: str = "10 minutes"):
    """key, last_ts, fired_at for each key that no row has touched for ttl_seconds of event time: a resettable timer a key.

    Each row re-arms its key's timer; one that runs out before a row of the same micro-batch fires first. State is one time a key.
    """
    timed = with_event_time(stream.select(key, ts), ts, late)

    def on_rows(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fired, last = [], state.get[0] if state.exists else None
        ttl = ttl_seconds * 1000
        if state.hasTimedOut:
            state.remove()
            yield _fired(k, [last], ttl, key)
            return
        times = sorted(int(t.value // 1_000_000) for pdf in batches for t in pdf[ts])
        for t in times:
            if last is not None and t >= last + ttl:
                fired.append(last)
            last = t if last is None else max(last, t)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + ttl, state.getCurrentWatermarkMs() + 1))
        yield _fired(k, fired, ttl, key)

    kind = dict(timed.dtypes)[key]
    return timed.groupBy(key).applyInPandasWithState(on_rows, f"{key} {kind}, last_ts timestamp, fired_at timestamp", "last long", "append", "EventTimeTimeout")


def _fired(k: tuple, lasts: list[int], ttl: int, key: str) -> pd.DataFrame:
    at = pd.to_datetime(pd.Series(lasts, dtype="int64"), unit="ms")
    return pd.DataFrame({key: [k[0]] * len(lasts), "last_ts": at, "fired_at": at + pd.Timedelta(milliseconds=ttl)})
