"""Quote lines and array-row payloads to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed field positions of a quote line (0-based, '~' separated)
FIELDS = {"price": 3, "prev_close": 4, "open": 5, "high": 33, "low": 34, "volume": 6}


def _num(parts: Column, i: int) -> Column:
    return F.coalesce(F.get(parts, F.lit(i)).try_cast("double"), F.lit(0.0))


def parse_quotes(lines: DataFrame, column: str = "value") -> DataFrame:
    """``v_code="f0~f1~..."`` statements (several per line) to snapshot rows; non-positive prices are dropped."""
    other = [c for c in lines.columns if c != column]
    x = lines.select(*other, F.explode(F.split(column, ";")).alias("_s")).filter(F.col("_s").contains("="))
    x = x.select(*other, F.regexp_extract("_s", r"v_(\w+)\s*=", 1).alias("code"),
                 F.split(F.regexp_extract("_s", '"([^"]*)"', 1), "~").alias("_f"))
    x = x.select(*other, "code", *[_num(F.col("_f"), i).alias(n) for n, i in FIELDS.items()])
    return x.filter((F.col("price") > 0) & (F.col("prev_close") > 0))


def parse_array_rows(df: DataFrame, column: str = "payload") -> DataFrame:
    """JSON ``[[date, open, close, high, low, volume], ...]`` to bar columns; unparsable numbers are null."""
    other = [c for c in df.columns if c != column]
    rows = F.explode(F.from_json(column, "array<array<string>>"))
    x = df.select(*other, rows.alias("_r"))
    names = ("open", "close", "high", "low", "volume")
    return x.select(*other, F.get("_r", F.lit(0)).try_cast("date").alias("date"),
                    *[F.get("_r", F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)])
