"""Streams of frames or events: windows with late data, and boundaries with state for each sequence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, ts: str, key: str, value: str, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums of tumbling windows; events later than `late` are dropped by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def boundaries(events: DataFrame, key: str, at: str, value: str, threshold: float, gap: float) -> DataFrame:
    """key, at, change: changes of at least `threshold` from one event of a key to the next, `gap` after the last one that
    was accepted. The state of a key is its last value and its last boundary, so it is bounded."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_value, last_at = state.get if state.exists else (None, None)
        rows = []
        for t, v in sorted((t, v) for b in batches for t, v in zip(b[at], b[value])):
            if last_value is not None and abs(v - last_value) >= threshold and (last_at is None or t - last_at >= gap):
                rows.append((k[0], float(t), abs(v - last_value)))
                last_at = float(t)
            last_value = float(v)
        state.update((last_value, last_at))
        yield pd.DataFrame(rows, columns=[key, "at", "change"])

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, at double, change double", "value double, at double", "append", GroupStateTimeout.NoTimeout)
