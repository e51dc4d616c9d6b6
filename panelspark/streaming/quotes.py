"""Snapshot stream: source, session filter, drift against the T-1 baseline, sinks.

The transformations are plain DataFrame functions, so the same code runs on a batch or a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.scalar import trading_hours
from panelspark.schema import SNAPSHOT
from panelspark.sources.quotes import parse_quotes


def quote_stream(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """Text files of quote lines, one micro-batch per arrival of up to ``max_files`` files."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return parse_quotes(lines.select("value", F.col("_metadata.file_modification_time").alias("ts"))).withColumnRenamed("code", "symbol")


def snapshot_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SNAPSHOT).json(path)


def change_pct(df: DataFrame) -> DataFrame:
    """Change against the previous close, 0 where that is missing."""
    ok = F.col("prev_close") > 0
    return df.withColumn("change_pct", F.when(ok, F.col("price") / F.when(ok, F.col("prev_close")) - 1).otherwise(0.0))


def in_session(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.filter(trading_hours(ts))


def drift_state(snapshots: DataFrame, baseline: DataFrame, threshold: float = 0.01, max_age_days: int = 5) -> DataFrame:
    """intact / stale / unknown per snapshot against the symbol's T-1 baseline (static side, one row per symbol).

    ``baseline``: symbol, base_date, base_close, direction ('up' / 'down' / null), available.
    """
    j = snapshots.join(baseline, "symbol", "left")
    move = F.col("price") / F.nullif("base_close", F.lit(0.0)) - 1
    old = F.datediff(F.to_date("ts"), "base_date") > max_age_days
    against = ((F.col("direction") == "up") & (move < -threshold)) | ((F.col("direction") == "down") & (move > threshold))
    state = F.when(F.col("direction").isNull() | ~F.coalesce("available", F.lit(False)) | old, "unknown").when(against, "stale").otherwise("intact")
    return j.withColumns({"move": move, "drift": state})


def poll_summary(batch: DataFrame) -> DataFrame:
    """Counts per drift state and the stale symbols of one micro-batch (symbols per state: the universe)."""
    return batch.groupBy("drift").agg(F.count(F.lit(1)).alias("snapshots"), F.count_distinct("symbol").alias("symbols"))


def run_polls(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True, seconds: int = 30):
    """One micro-batch per poll: its snapshots by day, its summary beside them.  A poll that runs again after a restart replaces its own folders."""
    def write(batch: DataFrame, epoch: int) -> None:
        b = batch.persist()
        try:
            b.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{out}/snapshots/epoch={epoch}")
            poll_summary(b).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/summary/poll={epoch}")
        finally:
            b.unpersist()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{seconds} seconds")).start()
