"""Streaming twins of stateful operators: event-time windows, and heat per user with the batch operator's results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alert_windows(events: DataFrame, time: str, group: str, window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events per group in sliding windows under a watermark; closed windows come out once (append mode)."""
    usable = events.where(F.col(time).isNotNull())
    w = F.window(F.col(time), window, slide)
    return usable.withWatermark(time, late).groupBy(w, F.col(group)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), group, "n")


def stream_heat(events: DataFrame, key: str, time: str, id_: str, points: str, ttl_seconds: int = 3600, limit: int = 10, late: str = "10 minutes") -> DataFrame:
    """Heat after each event of a stream, one state (heat, last time) per key.

    The idle reset compares event times, as the batch operator does.  Events of a key in one micro-batch are
    ordered by time and id; an event older than the key's last one is taken at the last one's time.  Events
    later than the watermark ``late`` are dropped and counted by the engine.  A key's state goes once the
    watermark is past the time at which it would start anew, so idle keys cost nothing.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    out = f"`{key}` {kinds[key]}, `{id_}` {kinds[id_]}, heat long, tripped boolean"
    ttl = ttl_seconds * 1_000_000

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        heat, last = state.get if state.exists else (0, None)
        pdf = pd.concat(list(batches)).sort_values(["_us", id_])
        rows = []
        for us, i, add in zip(pdf["_us"], pdf[id_], pdf[points], strict=True):
            if last is not None and us - last > ttl:
                heat = 0
            heat = heat * 9 // 10 + int(add) if add else max(heat * 9 // 10 - 1, 0)
            last = int(us) if last is None else max(last, int(us))
            rows.append((k[0], i, heat, heat >= limit))
        state.update((int(heat), last))
        state.setTimeoutTimestamp(max((last + ttl) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[key, id_, "heat", "tripped"])

    usable = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    usable = usable.select(key, time, id_, points, F.unix_micros(time).alias("_us"))
    return usable.groupBy(key).applyInPandasWithState(run, out, "heat long, last long", "append", "EventTimeTimeout")
