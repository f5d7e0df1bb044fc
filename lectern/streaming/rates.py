"""Streams: rate limits and one-time tokens with state that expires, incremental counts.

State of a key is dropped when the watermark passes the time from which it can make no difference, so it grows with the keys that
are live and not with all that were ever seen. Rows are taken in the order of their time within a batch; a batch is bounded
by what its trigger admits. Rows that come later than the watermark allows are dropped, as in any windowed stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _expire(state: GroupState, ms: int) -> None:
    """Drops the state once the watermark has passed ``ms``, or with the next batch if it has already."""
    state.setTimeoutTimestamp(max(int(ms), state.getCurrentWatermarkMs() + 1))


def _rows(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


def _timed(rows: DataFrame, late: str) -> DataFrame:
    return rows.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", late)


def rate_limit(hits: DataFrame, limit: int, window_ms: int, late: str = "1 hour") -> DataFrame:
    """(key, ms, id, count, allowed) of a stream of hits (key, ms, id): a window starts at the first hit after the last ended."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        rows, counts = _rows(frames, ["ms", "id"]), []
        for ms in rows["ms"].tolist():
            if start is None or start <= ms - window_ms:
                start, n = ms, 0
            n += 1
            counts.append(n)
        state.update((start, n))
        _expire(state, start + window_ms)
        yield pd.DataFrame({"key": key[0], "ms": rows["ms"], "id": rows["id"], "count": counts, "allowed": [c <= limit for c in counts]})

    out = "key long, ms long, id long, count long, allowed boolean"
    return _timed(hits, late).groupBy("key").applyInPandasWithState(step, out, "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def one_time(uses: DataFrame, ttl_ms: int, late: str = "1 hour") -> DataFrame:
    """(token, ms, id, accepted) of a stream of uses (token, ms, id, issued): the first use within ``ttl_ms`` of the issue counts.

    ``issued`` is when the token was given out. A used token is remembered until it would have expired anyway.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.exists
        rows, accepted = _rows(frames, ["ms", "id"]), []
        for ms, issued in zip(rows["ms"].tolist(), rows["issued"].tolist(), strict=True):
            good = not used and ms < issued + ttl_ms
            used = used or good
            accepted.append(good)
        if used:
            state.update((True,))
            _expire(state, rows["issued"].max() + ttl_ms)
        yield pd.DataFrame({"token": key[0], "ms": rows["ms"], "id": rows["id"], "accepted": accepted})

    return _timed(uses, late).groupBy("token").applyInPandasWithState(step, "token long, ms long, id long, accepted boolean", "used boolean", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, home: str) -> DataFrame:
    """All that a stream gives for what its source holds now, written to a folder and read again."""
    query = stream.writeStream.format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{home}/rows")


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by hour and type with a watermark; the timestamp must have a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
