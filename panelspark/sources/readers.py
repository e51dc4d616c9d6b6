"""File sources and sinks: bars, macro series, snapshot logs, append-only registries, column-store layout, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators.cleaning import dedupe, min_rows
from panelspark.schema import MACRO, SNAPSHOT, required_columns


def _stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.\w+)+$", 1)


def _line() -> Column:
    """Orders the rows of a file as they stand in it: the block a task reads, then the row within the task."""
    return F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def read_bars(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """One file per symbol (name = symbol) or files with a symbol column; first row per (symbol, date) wins."""
    schema = "date date, open double, high double, low double, close double, volume double"
    if fmt == "csv":
        df = spark.read.schema(schema).option("header", True).csv(path)
        df = df.select(_stem().alias("symbol"), "*", _line().alias("arrival"))
    else:
        df = spark.read.format(fmt).load(path)
        if "symbol" not in df.columns:
            df = df.withColumn("symbol", _stem())
        df = df.withColumn("arrival", _line())
    required_columns(df, ("symbol", "date", "open", "high", "low", "close", "volume"))
    return dedupe(df, order=("arrival",)).drop("arrival")


def load_pool(spark: SparkSession, path: str, start: str | None, end: str | None, min_train_rows: int, fmt: str = "csv") -> DataFrame:
    """All symbols in the date window with enough rows."""
    from panelspark.operators.cleaning import clip_window

    return min_rows(clip_window(read_bars(spark, path, fmt), start, end), min_train_rows)


def read_macro(spark: SparkSession, path: str, prefix: str = "macro_") -> DataFrame:
    """``date,value`` CSV files, one indicator per file name, first value per (indicator, date)."""
    df = spark.read.schema("date string, value string").option("header", True).csv(path)
    df = df.select(F.regexp_replace(_stem(), f"^{prefix}", "").alias("indicator"), F.col("date").try_cast("date").alias("date"),
                   F.col("value").try_cast("double").alias("value"), _line().alias("arrival"))
    df = df.filter(F.col("date").isNotNull() & F.col("value").isNotNull())
    return dedupe(df, ("indicator", "date"), ("arrival",)).select(*MACRO.fieldNames())


def append_snapshots(df: DataFrame, path: str) -> None:
    """Append-only snapshot log, one folder per day."""
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def read_snapshots(spark: SparkSession, path: str, day: str | None = None, symbol: str | None = None) -> DataFrame:
    """Reads the log; corrupt lines are dropped, a day filter prunes folders."""
    df = spark.read.schema(SNAPSHOT).option("mode", "DROPMALFORMED").json(path)
    if day:
        df = df.filter(F.col("day") == F.lit(day).cast("date"))
    return df.filter(F.col("symbol") == symbol) if symbol else df


def retained(df: DataFrame, asof: str, keep_days: int, column: str = "day") -> DataFrame:
    """Rows of the last ``keep_days`` days; write back with dynamic partition overwrite or drop the older folders."""
    return df.filter(F.col(column) >= F.date_sub(F.lit(asof).cast("date"), keep_days))


def fresh_files(spark: SparkSession, path: str, ttl_seconds: int, now: str, fmt: str = "parquet") -> DataFrame:
    """Rows of cached files younger than the time to live."""
    df = spark.read.format(fmt).load(path)
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("_metadata.file_modification_time"))
    return df.filter(age <= ttl_seconds)


def standardise(bars: DataFrame, rows: int = 60) -> DataFrame:
    """Positive-only rows of symbols with enough history, adjustment factor 1."""
    ok = (F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0) & (F.col("volume") >= 0)
    return min_rows(bars.filter(ok), rows).withColumn("factor", F.lit(1.0))


def column_store(bars: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(values, calendar, instruments): long values keyed by calendar ordinal, the global calendar, symbol ranges."""
    days = bars.select("date").distinct()
    cal = days.withColumn("ordinal", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")) - 1)  # one row per day
    inst = bars.groupBy("symbol").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    fields = ["open", "high", "low", "close", "volume"]
    vals = bars.join(cal, "date").select("symbol", "ordinal", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("_z"))
    return vals.select("symbol", "ordinal", F.col("_z.field").alias("field"), F.col("_z.value").alias("value")), cal, inst


def write_column_store(bars: DataFrame, path: str) -> None:
    vals, cal, inst = column_store(bars)
    vals.write.mode("overwrite").partitionBy("field").parquet(f"{path}/values")
    cal.write.mode("overwrite").parquet(f"{path}/calendar")
    inst.write.mode("overwrite").parquet(f"{path}/instruments")


def append_predictions(df: DataFrame, path: str) -> None:
    """Append to the prediction log; a record without symbol or horizon fails the write."""
    bad = F.col("symbol").isNull() | (F.trim("symbol") == "") | F.col("horizon").isNull()
    df.withColumn("symbol", F.when(bad, F.raise_error(F.lit("prediction without symbol or horizon"))).otherwise(F.col("symbol"))) \
        .write.mode("append").parquet(path)


def export_feed(feed: DataFrame, path: str) -> None:
    """Nested feed as JSON and its flattened orders as CSV."""
    feed.write.mode("overwrite").json(f"{path}/json")
    if "orders" in feed.columns:
        feed.select("symbol", F.explode("orders").alias("o")).select("symbol", "o.*").write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def seed_payload(feed: DataFrame, columns: list[str]) -> DataFrame:
    """Flat float columns of a feed plus the same as one JSON text per symbol."""
    flat = [F.col(c).cast("double").alias(c) for c in columns]
    return feed.select("symbol", *flat, F.to_json(F.struct(*flat)).alias("payload"))
