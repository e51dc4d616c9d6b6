"""Panel tables derived from the star-schema parquet folder (bars, ticks, macro, news, scores, predictions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators.windows import Series

# fixed values: English lexicon used on the synthetic prose (its words are built from these syllables)
POSITIVE = ["that", "blees", "with", "heron", "therin"]
NEGATIVE = ["whou", "thon", "anan", "ofat", "inhe"]

HORIZONS = (5, 10, 20)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars: one row per (brand, ship day), open/close by line key.  Partial aggregation absorbs hot brands."""
    li = table(spark, sf, "lineitem").select(
        "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    px = F.col("l_extendedprice") / F.col("l_quantity")
    # one long per line keeps min_by/max_by in the hash aggregate (a struct key would force a sort aggregate)
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + (F.col("l_partkey") * 8191 + F.col("l_suppkey")) % 1048576
    j = li.join(part, "l_partkey").select(
        "symbol", F.to_date("l_shipdate").alias("date"), px.alias("px"), key.alias("k"), "l_quantity")
    return j.groupBy("symbol", "date").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", "k").alias("close"), F.sum("l_quantity").alias("volume"))


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
                    "user_id", F.col("value").alias("price"), "props")


def hour_bars(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf).withColumn("hour", F.date_trunc("hour", "ts"))
    return t.groupBy("symbol", F.col("hour").alias("ts")).agg(
        F.min_by("price", "event_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "event_id").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))


def macro(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("indicator"), F.last_day("o_orderdate").alias("date")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("value"))


def news(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.date_add(F.lit("1996-01-01").cast("date"), F.pmod("doc_id", F.lit(97)).cast("int")).alias("date"),
                    F.col("text").alias("title"), "source")


def scores(bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Causal score p_up = logistic(10 * ma_20_ratio) and the h-row forward return, one row per horizon."""
    s = Series()
    ma = s.mean("close", 20)
    x = bars.select("symbol", "date", "close", (F.col("close") / ma - 1).alias("r"),
                    *[(s.lead("close", h) / F.col("close") - 1).alias(f"f{h}") for h in horizons])
    x = x.filter(F.col("r").isNotNull()).withColumn("p_up", 1 / (1 + F.exp(-10 * F.col("r"))))
    arms = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("fwd_ret")) for h in horizons])
    return x.select("symbol", "date", "close", "p_up", F.explode(arms).alias("a")).select(
        "symbol", "date", "close", F.col("a.horizon").alias("horizon"), "p_up", F.col("a.fwd_ret").alias("fwd_ret"))


def predictions(scores: DataFrame, step: int = 5) -> DataFrame:
    """Prediction log: every ``step``-th scored bar of each symbol and horizon."""
    s = Series(keys=("symbol", "horizon"))
    p = scores.withColumn("rn", s.row()).filter((F.col("rn") - 1) % step == 0)
    return p.select("symbol", "horizon", F.col("date").alias("latest_date"), F.col("close").alias("latest_close"), "p_up",
                    (2 * F.abs(F.col("p_up") - 0.5)).alias("confidence"))


def bad_bars(bars: DataFrame) -> DataFrame:
    """Bars with planted faults: second copies, negative closes, inverted ranges, missing volume."""
    d = F.dayofmonth("date")
    a = bars.withColumn("arrival", F.lit(1))
    copy = bars.filter(d % 7 == 0).withColumn("close", F.col("close") + 1).withColumn("arrival", F.lit(2))
    u = a.unionByName(copy)
    return u.withColumns({
        "close": F.when((d % 11 == 0) & (F.col("arrival") == 1), -F.col("close")).otherwise(F.col("close")),
        "high": F.when(d % 13 == 0, F.col("low") - 1).otherwise(F.col("high")),
        "volume": F.when(d % 5 == 0, None).otherwise(F.col("volume")),
    })


def instruments(spark: SparkSession, sf: str) -> DataFrame:
    """Instrument codes with exchange suffixes, one per part."""
    p = table(spark, sf, "part")
    code = F.lpad((F.col("p_partkey") * 7919 % 700000).cast("string"), 6, "0")
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".sh", ".SZ", ".SHF", ".FXCM", ".XX", "")]), (F.col("p_size") % 6 + 1).cast("int"))
    return p.select("p_partkey", F.concat(F.lit(" "), code, suffix).alias("raw_symbol"))


def quote_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Text lines in the quote format, one per event; every ninth has no previous close."""
    e = table(spark, sf, "events")
    v = F.col("value").cast("string")
    prev = F.when(F.col("event_id") % 9 == 0, "0").otherwise((F.col("value") + 1).cast("string"))
    user = F.col("user_id").cast("string")
    line = F.concat(F.lit("v_sh"), user, F.lit('="1~name~'), user, F.lit("~"), v, F.lit("~"), prev, F.lit("~"), v, F.lit("~100"),
                    F.lit("~" * 27), v, F.lit("~"), v, F.lit('~";'))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), line.alias("value"))


def snapshot_b(bars: DataFrame) -> DataFrame:
    """Second snapshot: the first three rows missing and the older third rescaled."""
    s = Series()
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    x = bars.withColumns({"_rn": s.row(), "_n": n}).filter(F.col("_rn") > 3)
    old = F.col("_rn") < F.col("_n") / 3
    return x.withColumns({c: F.when(old, F.col(c) * 1.1).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}).drop("_rn", "_n")
