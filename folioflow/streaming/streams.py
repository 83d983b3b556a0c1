"""Incremental forms of the operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def distinct_hits(stream: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows whose key hasn't come before (T1, U5); a watermark on an event time bounds the state."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys) if time else stream.dropDuplicates(keys)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows of a key in event-time windows, late rows up to a delay counted in."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width, slide), *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, delay: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after a gap."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))


def newest(stream: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """The newest value of every key; late older ones change nothing."""
    return stream.groupBy(key).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))


def gap_fold(stream: DataFrame, key: str, index: str) -> DataFrame:
    """Per key the first missing index, kept as state over arriving indexes (T4).

    The state is the first missing index and the arrived indexes beyond it only.
    """

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, beyond = state.get if state.exists else (0, [])
        pending = set(beyond)
        for b in batches:
            pending.update(int(x) for x in b[index] if x is not None and x >= at)
        while at in pending:
            pending.discard(at)
            at += 1
        state.update((at, sorted(pending)))
        yield pd.DataFrame({key: [k[0]], "first_missing": [at], "pending": [len(pending)]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, first_missing bigint, pending bigint", "at bigint, beyond array<bigint>", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Processes what is there, once, and stops (tests, backfills)."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.foreachBatch(each) if each else w.format("memory").queryName(name)).start()
    q.awaitTermination()
