"""Labels (forward looking) and cross-sectional columns (one date, all symbols)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.order_stats import with_average_rank
from panelspark.operators.windows import Series

S = Series()


def binary_target(bars: DataFrame, h: int) -> DataFrame:
    """1 where the close ``h`` rows ahead is higher, 0 otherwise, null on the tail."""
    f = S.lead("close", h)
    return bars.withColumn(f"target_{h}d", F.when(f.isNotNull(), (f > F.col("close")).cast("int")))


def forward_returns(bars: DataFrame, horizons: Sequence[int]) -> DataFrame:
    return bars.withColumns({f"fwd_{h}": S.lead("close", h) / F.col("close") - 1 for h in horizons})


def triple_barrier(bars: DataFrame, horizon: int = 10, k_up: float = 1.5, k_down: float = 1.5, sigma: str = "sigma") -> DataFrame:
    """First touch of close*(1 +- k*sigma) within the next ``horizon`` bars: 1, -1, 0 for both in one bar; else the
    sign of the terminal return; null without sigma or before maturity."""
    ahead = S.w.rowsBetween(1, horizon)
    df = bars.withColumns({"_path": F.collect_list(F.struct("high", "low")).over(ahead), "_end": S.lead("close", horizon)})
    up, down = F.col("close") * (1 + k_up * F.col(sigma)), F.col("close") * (1 - k_down * F.col(sigma))
    touch = F.transform("_path", lambda b: F.when((b["high"] >= up) & (b["low"] <= down), 0).when(b["high"] >= up, 1).when(b["low"] <= down, -1))
    first = F.try_element_at(F.filter(touch, lambda t: t.isNotNull()), F.lit(1))
    label = F.coalesce(first, F.signum(F.col("_end") - F.col("close")).cast("int"))
    ok = F.col(sigma).isNotNull() & F.col("_end").isNotNull() & (F.col("close") > 0)
    return df.withColumn("tb_label", F.when(ok, label)).drop("_path", "_end")


def to_binary(label: str | Column) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c == 1, 1).when(c == -1, 0)


def label_summary(df: DataFrame, label: str = "tb_label", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    c = F.col(label)

    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0))

    g = df.groupBy(*keys).agg(n(c == 1).alias("up"), n(c == -1).alias("down"), n(c == 0).alias("neutral"), n(c.isNull()).alias("pending"))
    tot = F.col("up") + F.col("down") + F.col("neutral")
    return g.withColumns({"labeled": tot, **{f"{k}_ratio": F.try_divide(F.col(k), tot) for k in ("up", "down", "neutral")}})


def forward_risk(bars: DataFrame, h: int, vol_window: int = 20) -> DataFrame:
    """Future volatility and drawdown over rows t+1..t+h relative to t, and trailing volatility, scaled by sqrt(h)."""
    df = bars.withColumn("_r", S.pct("close"))
    ahead = S.w.rowsBetween(1, h)
    full, root = F.count("close").over(ahead) >= h, float(h) ** 0.5
    return df.withColumns({
        "fwd_vol": F.when(full, F.stddev_samp("_r").over(ahead)) * root, "fwd_mdd": F.when(full, F.min("close").over(ahead)) / F.col("close") - 1,
        "trail_vol": S.std("_r", vol_window) * root,
    }).drop("_r")


def anchors(bars: DataFrame, h: int, step: int = 5, max_anchors: int | None = None) -> DataFrame:
    """Every ``step``-th row counted back from the last matured one, all or the newest ``max_anchors`` per symbol, with its return."""
    back = Window.partitionBy("symbol").orderBy(F.desc("date"))
    df = bars.withColumns({"fwd_ret": S.lead("close", h) / F.col("close") - 1, "_k": F.row_number().over(back) - 1 - h, "_rn": S.row()})
    keep = (F.col("_k") >= 0) & (F.col("_k") % step == 0) & (F.col("_rn") > 1)
    if max_anchors is not None:
        keep = keep & (F.col("_k") / step < max_anchors)
    return df.filter(keep).drop("_k", "_rn")


def supervised(features: DataFrame, feature_cols: Sequence[str], h: int) -> DataFrame:
    """Feature columns with target, forward return and trailing volatility; immature rows dropped."""
    df = features.withColumns({"target": F.when(S.lead("close", h).isNotNull(), (S.lead("close", h) > F.col("close")).cast("int")),
                               "_fwd_ret": S.lead("close", h) / F.col("close") - 1, "_r": S.pct("close")})
    df = df.withColumn("_vol", S.std("_r", 20))
    return df.filter(F.col("target").isNotNull()).dropna(subset=list(feature_cols)).select("symbol", "date", *feature_cols, "target", "_fwd_ret", "_vol")


def windows_dataset(bars: DataFrame, columns: Sequence[str], lookback: int, horizon: int, bound: float = 5.0) -> DataFrame:
    """Sliding windows: past-only normalised sequence per column, and the next ``horizon`` closes as target path."""
    fr, ahead = S.frame(lookback), S.w.rowsBetween(1, horizon)
    df = bars.withColumns({f"_{c}_m": F.avg(c).over(fr) for c in columns} | {f"_{c}_s": F.stddev_pop(c).over(fr) for c in columns}
                          | {f"_{c}_x": F.collect_list(c).over(fr) for c in columns} | {"_y": F.collect_list("close").over(ahead)})
    df = df.filter((F.size(f"_{columns[0]}_x") == lookback) & (F.size("_y") == horizon))

    def normalised(c: str) -> Column:
        m, s = F.col(f"_{c}_m"), F.col(f"_{c}_s") + 1e-5
        return F.transform(f"_{c}_x", lambda x: F.greatest(F.lit(-bound), F.least(F.lit(bound), (x - m) / s)))

    seq = {f"{c}_seq": normalised(c) for c in columns}
    return df.withColumns(seq).select("symbol", "date", *seq, F.col("_y").alias("target_path"))


# ---- cross-section
def cross_section(bars: DataFrame) -> DataFrame:
    """Percent ranks of the 1-row return and 20-row momentum, excess over the pool mean, and dispersion, per date."""
    df = bars.withColumns({"ret_1": S.pct("close"), "mom_20": S.pct("close", 20)})
    df = with_average_rank(with_average_rank(df, ["date"], "ret_1", "_a"), ["date"], "mom_20", "_b")
    day = df.groupBy("date").agg(F.count("ret_1").alias("_na"), F.count("mom_20").alias("_nb"), F.avg("ret_1").alias("_m"), F.stddev_samp("ret_1").alias("xsec_dispersion"))
    j = df.join(day, "date")
    return j.withColumns({"xsec_ret_rank": F.col("_a") / F.col("_na"), "xsec_mom_rank": F.col("_b") / F.col("_nb"),
                          "xsec_excess": F.col("ret_1") - F.col("_m")}).drop("_a", "_b", "_na", "_nb", "_m")


def regime_observations(prices: DataFrame, keys: Sequence[str] = ("symbol",), n: int = 20, ret: str | None = None) -> DataFrame:
    """Log return (of ``close``, or of a simple-return column) and its population deviation over ``n`` rows."""
    s = Series(keys=keys)
    df = prices.withColumn("log_ret", F.log1p(ret) if ret else F.log(F.col("close") / s.lag("close")))
    return df.withColumn("vol", s.std_pop("log_ret", n))


def rule_regime(df: DataFrame, ret: str = "log_ret", keys: Sequence[str] = ("symbol",), n: int = 20, cut: float = 0.02) -> DataFrame:
    """bull/bear/range by the sum of the last ``n`` returns (shorter frames at the start)."""
    s = Series(keys=keys)
    x = F.coalesce(F.sum(ret).over(s.frame(n)), F.lit(0.0))
    return df.withColumn("regime", F.when(x > cut, "bull").when(x < -cut, "bear").otherwise("range"))


def regime_onehot(df: DataFrame, column: str = "regime", states=("bull", "range", "bear")) -> DataFrame:
    return df.withColumns({f"regime_{s}": F.when(F.col(column) == s, 1.0).otherwise(0.0) for s in states})


def market_residuals(returns: DataFrame, ret: str = "ret") -> DataFrame:
    """Per-symbol alpha and beta against the equal-weight market, and the residual of every row."""
    m = returns.groupBy("date").agg(F.avg(ret).alias("market"))
    j = returns.join(m, "date")
    fit = j.groupBy("symbol").agg(F.regr_slope(ret, "market").alias("beta"), F.regr_intercept(ret, "market").alias("alpha"))
    return j.join(fit, "symbol").withColumn("residual", F.col(ret) - F.col("alpha") - F.col("beta") * F.col("market"))
