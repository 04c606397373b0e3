"""The interval-bar aggregation on a stream: the same plan, with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quantloom.sources.tables import interval_bars


def streaming_bars(ticks: DataFrame, interval: str, lateness: str = "10 minutes", key: str = "ticker", ts: str = "ts") -> DataFrame:
    """Bars of a streaming tick table; a bar is final once the watermark passes its end."""
    return interval_bars(ticks.withWatermark(ts, lateness), interval, key=key, ts=ts)
