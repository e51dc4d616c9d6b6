"""Bars from ticks with event-time windows and watermarks; duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ohlcv(grouped) -> DataFrame:
    first, last = F.min_by("price", F.struct("ts", "event_id")), F.max_by("price", F.struct("ts", "event_id"))
    return grouped.agg(first.alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), last.alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))


def tumbling_bars(ticks: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(symbol, ts, OHLCV) per window; on a stream rows later than the watermark are dropped."""
    g = _ohlcv(_wm(ticks, lateness).groupBy("symbol", F.window("ts", width)))
    return g.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def sliding_bars(ticks: DataFrame, width: str = "1 hour", slide: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    g = _ohlcv(_wm(ticks, lateness).groupBy("symbol", F.window("ts", width, slide)))
    return g.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def session_bars(ticks: DataFrame, gap: str = "20 minutes", lateness: str = "10 minutes", key: str = "symbol") -> DataFrame:
    g = _wm(ticks, lateness).groupBy(key, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("high"), F.min("price").alias("low"))
    return g.select(key, F.col("session_window.start").alias("ts"), F.col("session_window.end").alias("end"), "n", "high", "low")


def unique_snapshots(ticks: DataFrame, lateness: str = "10 minutes", keys=("symbol", "ts"), order=("ts", "event_id")) -> DataFrame:
    """First snapshot per key: along ``order`` in a batch, by arrival on a stream, where state is kept only inside the watermark."""
    if ticks.isStreaming:
        return ticks.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(list(keys))
    rest = [c for c in ticks.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return ticks.groupBy(*keys).agg(first.alias("_first")).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def _wm(df: DataFrame, lateness: str) -> DataFrame:
    return df.withWatermark("ts", lateness) if df.isStreaming else df
