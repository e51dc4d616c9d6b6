"""Spark-native operators for long panels keyed by (symbol, date)."""

__version__ = "0.1.0"
