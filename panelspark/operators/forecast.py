"""Rolling-origin forecasts, path summaries and forecast evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.windows import Series, pearson

S = Series()


def rolling_origins(bars: DataFrame, every: int, steps: int, lookback: int = 0) -> DataFrame:
    """(symbol, origin, last_close, step, date, price): the next ``steps`` bars after every ``every``-th row."""
    ahead = S.w.rowsBetween(1, steps)
    df = bars.withColumns({"_rn": S.row(), "_path": F.collect_list(F.struct("date", "close")).over(ahead)})
    df = df.filter((F.col("_rn") >= lookback) & ((F.col("_rn") - lookback) % every == 0))
    df = df.select("symbol", F.col("_rn").alias("origin"), F.col("close").alias("last_close"), F.posexplode("_path").alias("_p", "_x"))
    return df.select("symbol", "origin", "last_close", (F.col("_p") + 1).alias("step"), F.col("_x.date").alias("date"), F.col("_x.close").alias("price"))


def drift_forecast(origins: DataFrame, bars: DataFrame, lookback: int) -> DataFrame:
    """Baseline forecaster: the mean log step of the last ``lookback`` rows carried forward from each origin."""
    s = bars.withColumns({"_lr": F.log(F.col("close") / S.lag("close")), "origin": S.row()})
    mu = s.select("symbol", "origin", F.avg("_lr").over(S.frame(lookback)).alias("_mu"))
    return origins.join(mu, ["symbol", "origin"]).withColumn("forecast", F.col("last_close") * F.exp(F.col("_mu") * F.col("step"))).drop("_mu")


def forecast_errors(table: DataFrame, keys=("symbol",), within: float = 0.05) -> DataFrame:
    """MAPE, share within 5 %, direction accuracy against the previous actual, and correlation."""
    s = Series(keys=("symbol", "origin"), order=("step",))
    d = table.withColumn("_prev", F.coalesce(s.lag("price"), F.col("last_close")))
    err = F.abs(F.col("forecast") / F.col("price") - 1)
    up = (F.col("forecast") > F.col("_prev")) == (F.col("price") > F.col("_prev"))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(err).alias("mape"), F.avg((err <= within).cast("double")).alias("within_5pct"),
                                F.avg(up.cast("double")).alias("direction_accuracy"), pearson("forecast", "price").alias("correlation"))


def path_signals(paths: DataFrame, price: str = "forecast") -> DataFrame:
    """Last, mean, highest and lowest forecast of each path minus the last close."""
    g = paths.groupBy("symbol", "origin").agg(F.first("last_close").alias("_c"), F.max_by(price, "step").alias("last"), F.avg(price).alias("mean"), F.max(price).alias("high"), F.min(price).alias("low"))
    return g.select("symbol", "origin", *[(F.col(c) - F.col("_c")).alias(c) for c in ("last", "mean", "high", "low")])


def smooth_path(paths: DataFrame, length: int, price: str = "price", trend: float = 0.0) -> DataFrame:
    """Centred moving average of a path (window max(3, min(7, length // 5))) times a linear trend."""
    k = max(3, min(7, length // 5)) // 2
    w = Window.partitionBy("symbol", "origin").orderBy("step").rowsBetween(-k, k)
    return paths.withColumn("smoothed", F.avg(price).over(w) * (1 + trend * F.col("step") / length))


def recent_trend(bars: DataFrame, n: int = 20) -> DataFrame:
    """Slope of the last n closes times n over their range, and the strength |slope| * n / mean."""
    fr = S.frame(n)
    df = bars.withColumns({"_i": S.row(), "_rng": S.max("close", n) - S.min("close", n), "_ma": S.mean("close", n)})
    df = df.withColumn("_sl", F.when(F.col("_i") >= n, F.regr_slope("close", "_i").over(fr)))
    return df.withColumns({"trend": F.when(F.col("_rng") > 0, F.col("_sl") * n / F.nullif("_rng", F.lit(0.0))), "strength": F.abs(F.col("_sl")) * n / F.nullif("_ma", F.lit(0.0))}).drop("_i", "_rng", "_ma", "_sl")


def event_adjustment(df: DataFrame, events: DataFrame, k: int, price: str = "close") -> DataFrame:
    """Multiplies prices inside [event end, end + k) days by the event factor (events: a short calendar table)."""
    e = events.select("end", "factor").withColumn("date", F.explode(F.sequence("end", F.date_add("end", k - 1)))).groupBy("date").agg(F.max("factor").alias("_f"))
    return df.join(e, "date", "left").withColumn("adjusted", F.col(price) * F.coalesce("_f", F.lit(1.0))).drop("_f")


def bound_check(paths: DataFrame, limit: float = 0.3, price: str = "forecast") -> DataFrame:
    """Flags and clamps forecasts farther than ``limit`` from the last close."""
    lo, hi = F.col("last_close") * (1 - limit), F.col("last_close") * (1 + limit)
    out = (F.col(price) < lo) | (F.col(price) > hi)
    return paths.withColumns({"out_of_bounds": out.cast("int"), "clamped": F.greatest(lo, F.least(hi, F.col(price)))})
