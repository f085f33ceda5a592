"""Structured Streaming forms: sessions, and a ledger that forgets.

A session is a run of events with gaps of at most the given length (a gap of
exactly that length stays inside, as in gap clustering).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def batch_sessions(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, n, started, ended) by one window over the key."""
    w = Window.partitionBy(key).orderBy(ts)
    new = F.coalesce((F.col(ts) > F.lag(ts).over(w) + F.expr(f"interval {gap}")).cast("int"), F.lit(1))
    df = df.select(key, ts).withColumn("__n", new).withColumn("__s", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(key, "__s").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("started"), F.max(ts).alias("ended")).drop("__s")


def stream_sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of a stream, closed by the watermark. ``ts`` must be a timestamp.

    The engine's sessions end before a gap of exactly ``gap``; a microsecond more includes it.
    """
    longer = f"{gap} 1 microsecond"
    w = F.session_window(ts, longer)
    return events.withWatermark(ts, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("started"), F.max(ts).alias("ended")).drop("session_window")


def pending_stream(items: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """Items not seen in the last ``ttl_ms`` of processing time: a ledger as stream state."""

    def fresh(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        for _ in frames:
            pass
        if not state.exists:
            yield pd.DataFrame({key: [k[0]]})
        state.update((True,))
        state.setTimeoutDuration(ttl_ms)

    kind = items.schema[key].dataType.simpleString()
    return items.groupBy(key).applyInPandasWithState(fresh, f"{key} {kind}", "seen boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
