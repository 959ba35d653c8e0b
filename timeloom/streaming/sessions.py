"""Streaming versions of session and window operators; the tables of a library may be fed by a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_counts(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """key, start, end, n: sessions that close when the watermark has passed them by the gap."""
    w = F.session_window(at, gap)
    x = events.withWatermark(at, late).groupBy(key, w.alias("_w")).agg(F.count("*").alias("n"))
    return x.select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def windowed(events: DataFrame, at: str, length: str, late: str, *keys: str) -> DataFrame:
    """start, keys, n, total, peak: tumbling windows of ``value`` with a watermark."""
    x = events.withWatermark(at, late).groupBy(F.window(at, length).alias("_w"), *keys)
    return x.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("peak")).select(F.col("_w.start").alias("start"), *keys, "n", "total", "peak")


def capped(events: DataFrame, key: str, at: str, gap: float, cap: float, late: str = "1 minute") -> DataFrame:
    """key, start, end, n (seconds): scenes that end at a gap, or before an event more than ``cap`` behind their start.

    The state of a key is its open scene; a key that stays silent emits it when event time has passed it by the gap.
    """
    kind = dict(events.dtypes)[key]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, held = [], list(state.get) if state.exists else None
        if state.hasTimedOut:
            out.append(held)
            state.remove()
        else:
            for t in sorted(x for b in batches for x in (b[at].astype("int64") / (1e6 if "us" in str(b[at].dtype) else 1e9)).tolist()):
                if held and (t - held[1] > gap or t - held[0] > cap):
                    out.append(held)
                    held = None
                held = [held[0] if held else t, t, (held[2] if held else 0) + 1]
            state.update(tuple(held))
            state.setTimeoutTimestamp(max(int((held[1] + gap) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(out), "start": [x[0] for x in out], "end": [x[1] for x in out], "n": [x[2] for x in out]})

    x = events.select(key, at).withWatermark(at, late).groupBy(key)
    return x.applyInPandasWithState(run, f"{key} {kind}, start double, end double, n long", "start double, last double, n long", "append", GroupStateTimeout.EventTimeTimeout)
