"""Schemas of the panel tables and the column check every operator starts with."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

BARS = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType()),
    T.StructField("open", T.DoubleType()), T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()), T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])
MACRO = T.StructType([
    T.StructField("indicator", T.StringType()), T.StructField("date", T.DateType()), T.StructField("value", T.DoubleType()),
])
SCORES = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType()), T.StructField("horizon", T.IntegerType()),
    T.StructField("p_up", T.DoubleType()), T.StructField("fwd_ret", T.DoubleType()),
])
PREDICTIONS = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("horizon", T.IntegerType()),
    T.StructField("latest_date", T.DateType()), T.StructField("latest_close", T.DoubleType()),
    T.StructField("p_up", T.DoubleType()), T.StructField("confidence", T.DoubleType()),
])
SNAPSHOT = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("price", T.DoubleType()),
    T.StructField("prev_close", T.DoubleType()), T.StructField("open", T.DoubleType()), T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()), T.StructField("volume", T.DoubleType()),
])


def required_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Raise before any plan is built when a required column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
