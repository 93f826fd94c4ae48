"""Windows and liveness over event streams; the same functions serve batch tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STALE_MS = 15_000


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """hour, event_type, events, value: tumbling windows; on a stream, events later than the watermark are dropped."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "events", "value")


def liveness(beats: DataFrame, stale_ms: int = STALE_MS) -> DataFrame:
    """batch_id, state (live or stale): a batch is stale when no heartbeat (batch_id, ts) came for so long."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"batch_id": [key[0]], "state": ["stale"]})
            return
        for _ in batches:
            pass
        new = not state.exists
        state.update((1,))
        state.setTimeoutDuration(stale_ms)
        if new:
            yield pd.DataFrame({"batch_id": [key[0]], "state": ["live"]})

    return beats.groupBy("batch_id").applyInPandasWithState(run, "batch_id string, state string", "seen int", "append", GroupStateTimeout.ProcessingTimeTimeout)
