"""Technical indicators on the long bar table.  Every function takes bars and appends columns.

Trailing, lagged and cumulative columns are window expressions on one (symbol, date) layout, so a whole set costs one
shuffle; recursive columns share one grouped Arrow pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.recursion import ewm, with_recursive
from panelspark.operators.windows import Series, by_series, clip, nonzero
from panelspark.schema import required_columns

S = Series()
OHLCV = ("symbol", "date", "open", "high", "low", "close", "volume")


def _prepared(bars: DataFrame) -> DataFrame:
    """Shared intermediates: previous bar, close change, typical price, true range."""
    required_columns(bars, OHLCV)
    return by_series(bars).withColumns({
        "_pc": S.lag("close"), "_ph": S.lag("high"), "_pl": S.lag("low"), "_po": S.lag("open"), "_pv": S.lag("volume"), "_rn": S.row(),
    }).withColumns({
        "_d": F.col("close") - F.col("_pc"), "_tp": (F.col("high") + F.col("low") + F.col("close")) / 3,
        "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc"))),
        "_hl": F.col("high") - F.col("low"),
    })


def _drop_private(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def base_features(bars: DataFrame, windows=(5, 10, 20, 60)) -> DataFrame:
    """Moving averages and ratios, returns, RSI, volatility, Bollinger bands, volume ratio."""
    df = by_series(bars).withColumns({
        **{f"ma_{w}": S.mean("close", w) for w in windows},
        **{f"ret_{n}": S.pct("close", n) for n in (1, 5, 10)},
        "_d": S.diff("close"), "_mid": S.mean("close", 20), "_sd": S.std("close", 20), "_va": S.mean("volume", 20),
    })
    df = df.withColumns({
        **{f"ma_{w}_ratio": F.col("close") / F.col(f"ma_{w}") - 1 for w in windows},
        "_g": S.mean(F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0))), 14),
        "_l": S.mean(F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0))), 14),
        "volatility": S.std("ret_1", 20),
        "boll_upper": F.col("_mid") + 2 * F.col("_sd"), "boll_lower": F.col("_mid") - 2 * F.col("_sd"),
        "volume_ratio": F.col("volume") / nonzero("_va"),
    })
    df = df.withColumns({
        "rsi": 100 - 100 / (1 + F.col("_g") / (F.col("_l") + 1e-9)),
        "boll_pct_b": (F.col("close") - F.col("boll_lower")) / nonzero(F.col("boll_upper") - F.col("boll_lower")),
    })
    return _drop_private(df.withColumn("boll_pos", F.col("boll_pct_b")))


def trailing_indicators(bars: DataFrame, aroon_polarity: str = "standard") -> DataFrame:
    """Indicators over fixed trailing frames."""
    df = _prepared(bars)
    wm = {}
    for w in (10, 20):
        k = w * (w + 1) / 2
        wm[f"wma_{w}"] = (S.sum(F.col("_rn") * F.col("close"), w) - (F.col("_rn") - w) * S.sum("close", w)) / F.lit(k)
        wm[f"roc_{w}"] = S.pct("close", w) * 100
        wm[f"mom_{w}"] = S.diff("close", w)
    df = df.withColumns({
        **wm, "_sma12": S.mean("close", 12), "_sma20": S.mean("close", 20),
        "_hi14": S.max("high", 14), "_lo14": S.min("low", 14), "_tr14": S.sum("_tr", 14), "_tpm": S.mean("_tp", 14),
        "_tps": F.when(F.count("_tp").over(S.frame(14)) >= 14, F.collect_list("_tp").over(S.frame(14))),
        "_vp": S.sum(F.abs(F.col("high") - F.col("_pl")), 14), "_vm": S.sum(F.abs(F.col("low") - F.col("_ph")), 14),
        "_ge": S.sum(F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0), 14),
        "_ls": S.sum(F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0), 14),
        "_ptp": S.lag("_tp"), "stddev": S.std("close", 14),
        "_mfm": (2 * F.col("close") - F.col("low") - F.col("high")) / nonzero("_hl") * F.col("volume"),
        "_eom": (F.col("high") + F.col("low") - F.col("_ph") - F.col("_pl")) / 2 / nonzero(F.col("volume") / 1e8 / nonzero("_hl")),
        "_ai": F.when(F.count("high").over(S.frame(15)) >= 15, F.max_by("_rn", F.struct("high", -F.col("_rn"))).over(S.frame(15))),
        "_bi": F.when(F.count("low").over(S.frame(15)) >= 15, F.min_by("_rn", F.struct("low", "_rn")).over(S.frame(15))),
    })
    up, dn = F.col("_ai") - (F.col("_rn") - 14), F.col("_bi") - (F.col("_rn") - 14)  # 0 = oldest row of the frame
    if aroon_polarity == "oldest":
        up, dn = 14 - up, 14 - dn
    rsv = (F.col("close") - F.col("_lo14")) / nonzero(F.col("_hi14") - F.col("_lo14")) * 100
    mad = F.aggregate("_tps", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_tpm"))) / 14
    df = df.withColumns({
        "trima_12": S.mean("_sma12", 12), "trima_20": S.mean("_sma20", 20),
        "aroon_up": 100.0 * up / 14, "aroon_down": 100.0 * dn / 14,
        "cci": (F.col("_tp") - F.col("_tpm")) / (0.015 * nonzero(mad)),
        "vi_plus": F.col("_vp") / nonzero("_tr14"), "vi_minus": F.col("_vm") / nonzero("_tr14"),
        "stoch_k": rsv, "willr": (F.col("_hi14") - F.col("close")) / nonzero(F.col("_hi14") - F.col("_lo14")) * -100,
        "cmo": 100 * (F.col("_ge") - F.col("_ls")) / nonzero(F.col("_ge") + F.col("_ls")),
        "_pmf": S.sum(F.when(F.col("_tp") > F.col("_ptp"), F.col("_tp") * F.col("volume")).otherwise(0.0), 14),
        "_nmf": S.sum(F.when(F.col("_tp") < F.col("_ptp"), F.col("_tp") * F.col("volume")).otherwise(0.0), 14),
        "choppiness": 100 * F.log10(F.col("_tr14") / nonzero(F.col("_hi14") - F.col("_lo14"))) / F.log10(F.lit(14.0)),
        "cmf": S.sum("_mfm", 20) / nonzero(S.sum("volume", 20)), "eom": S.mean("_eom", 14),
    })
    df = df.withColumns({"stoch_d": S.mean("stoch_k", 3), "mfi": 100 - 100 / (1 + F.col("_pmf") / nonzero("_nmf"))})
    return _drop_private(df)


def cumulative_indicators(bars: DataFrame) -> DataFrame:
    """On-balance volume, VWAP since start, A/D line, price-volume trend, negative volume index."""
    df = _prepared(bars)
    pct = F.coalesce(F.col("_d") / F.col("_pc"), F.lit(0.0))
    step = F.when((F.col("volume") < F.col("_pv")) & (F.abs(1 + pct) != float("inf")), 1 + pct).otherwise(F.lit(1.0))
    df = df.withColumns({
        "obv": S.cumsum(F.signum(F.coalesce("_d", F.lit(0.0))) * F.col("volume")),
        "vwap": F.when(F.col("volume") != 0, S.cumsum(F.col("_tp") * F.col("volume")) / S.cumsum("volume")),
        "ad_line": S.cumsum((2 * F.col("close") - F.col("low") - F.col("high")) / nonzero("_hl") * F.col("volume")),
        "pvt": S.cumsum(pct * F.col("volume")), "nvi": 1000 * F.exp(S.cumsum(F.log(step))),
    })
    return _drop_private(df)


def patterns(bars: DataFrame) -> DataFrame:
    """Pivot levels of the previous bar and candle-pattern flags."""
    df = _prepared(bars).withColumns({"_o2": S.lag("open", 2), "_c2": S.lag("close", 2), "_phl": S.lag("_hl")})
    o, h, lo, c, po, pc, o2, c2 = (F.col(x) for x in ("open", "high", "low", "close", "_po", "_pc", "_o2", "_c2"))
    pivot, body = (F.col("_ph") + F.col("_pl") + pc) / 3, F.abs(c - o)
    upper, lower = h - F.greatest(o, c), F.least(o, c) - lo

    def flag(cond):
        return F.coalesce(cond, F.lit(False)).cast("int")

    df = df.withColumns({
        "pivot": pivot, "r1": 2 * pivot - F.col("_pl"), "s1": 2 * pivot - F.col("_ph"),
        "r2": pivot + (F.col("_ph") - F.col("_pl")), "s2": pivot - (F.col("_ph") - F.col("_pl")),
        "doji": flag(body / nonzero("_hl") < 0.1), "hammer": flag((lower > 2 * body) & (upper < body) & (body > 0)),
        "engulfing": flag((c > o) & (pc < po) & (c >= po) & (o <= pc)),
        "morning_star": flag((c2 < o2) & (F.abs(pc - po) / nonzero("_phl") < 0.1) & (c > o) & (c > (o2 + c2) / 2)),
    })
    return _drop_private(df)


def _recursive(p: pd.DataFrame) -> dict[str, pd.Series]:
    c, h, lo, v = p["close"], p["high"], p["low"], p["volume"]
    tiny = 1e-10
    e = {f"ema_{w}": ewm(c, span=w) for w in (5, 10, 20, 60)}
    out = dict(e)
    macd = ewm(c, span=12) - ewm(c, span=26)
    sig = ewm(macd, span=9)
    out |= {"macd": macd, "macd_signal": sig, "macd_hist": macd - sig}
    for w in (10, 20):
        e1 = e[f"ema_{w}"]
        e2 = ewm(e1, span=w)
        out[f"dema_{w}"], out[f"tema_{w}"] = 2 * e1 - e2, 3 * e1 - 3 * e2 + ewm(e2, span=w)
    er = ((c - c.shift(10)).abs() / c.diff().abs().rolling(10).sum().replace(0, tiny)).fillna(0).to_numpy()
    sc, x = (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2, c.to_numpy()
    k = x.copy()
    for i in range(10, len(x)):
        k[i] = k[i - 1] + sc[i] * (x[i] - k[i - 1])
    out["kama"] = pd.Series(k)
    tr = pd.concat([h - lo, (h - c.shift()).abs(), (lo - c.shift()).abs()], axis=1).max(axis=1)
    atr = ewm(tr, alpha=1 / 14)
    up, dn = h.diff(), -lo.diff()
    pdi = 100 * ewm(up.where((up > dn) & (up > 0), 0.0), alpha=1 / 14) / atr.replace(0, tiny)
    mdi = 100 * ewm(dn.where((dn > up) & (dn > 0), 0.0), alpha=1 / 14) / atr.replace(0, tiny)
    adx = ewm(100 * (pdi - mdi).abs() / (pdi + mdi).replace(0, tiny), alpha=1 / 14)
    out |= {"atr": atr, "natr": atr / c.replace(0, tiny) * 100, "adx": adx, "adxr": (adx + adx.shift(14)) / 2}
    lo9, hi9 = lo.rolling(9).min(), h.rolling(9).max()
    kk = ewm((c - lo9) / (hi9 - lo9).replace(0, tiny) * 100, alpha=1 / 3)
    dd = ewm(kk, alpha=1 / 3)
    out |= {"kdj_k": kk, "kdj_d": dd, "kdj_j": 3 * kk - 2 * dd}
    t3 = ewm(ewm(ewm(c, span=12), span=12), span=12)
    out["trix"] = (t3 / t3.shift() - 1) * 100
    m = c.diff()
    out["tsi"] = ewm(ewm(m, span=25) / ewm(m.abs(), span=25).replace(0, tiny), span=13) * 100
    r1 = ewm(h - lo, span=9)
    out["mass_index"] = (r1 / ewm(r1, span=9).replace(0, tiny)).rolling(25).sum()
    out["force_index"] = ewm(m * v, span=13)
    return {n: s.replace([np.inf, -np.inf], np.nan) for n, s in out.items()}


RECURSIVE = ["ema_5", "ema_10", "ema_20", "ema_60", "macd", "macd_signal", "macd_hist", "dema_10", "tema_10", "dema_20", "tema_20",
             "kama", "atr", "natr", "adx", "adxr", "kdj_k", "kdj_d", "kdj_j", "trix", "tsi", "mass_index", "force_index"]


def recursive_indicators(bars: DataFrame, keys=("symbol",), warm: str | None = None) -> DataFrame:
    """All recursive indicators in one pass; ``keys``/``warm`` accept blocked series."""
    return with_recursive(bars, _recursive, RECURSIVE, keys=keys, warm=warm)


def wilder_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Adds ``atr`` only."""
    def one(p: pd.DataFrame) -> dict[str, pd.Series]:
        pc = p["close"].shift()
        tr = pd.concat([p["high"] - p["low"], (p["high"] - pc).abs(), (p["low"] - pc).abs()], axis=1).max(axis=1)
        return {"atr": ewm(tr, alpha=1 / n)}
    return with_recursive(bars, one, ["atr"])


def support_resistance(bars: DataFrame, n: int = 20) -> DataFrame:
    """Lowest low and highest high of the n bars before the current one."""
    fr = S.w.rowsBetween(-n, -1)
    full = F.count("close").over(fr) >= n
    return bars.withColumns({"support": F.when(full, F.min("low").over(fr)), "resistance": F.when(full, F.max("high").over(fr))})


def label_volatility(bars: DataFrame, w: int = 20, min_prices: int = 5) -> DataFrame:
    """Sample deviation of log returns inside the last ``w`` prices (shorter frames allowed from ``min_prices``)."""
    c = F.col("close")
    ok = c.isNotNull() & ~F.isnan(c) & (c > 0) & (c != float("inf"))
    df = bars.withColumns({"_lr": F.when(ok & (S.lag("close") > 0), F.log(c / S.lag("close"))), "_ok": ok.cast("int")})
    prices, rets = S.frame(w), S.w.rowsBetween(-(w - 2), 0)
    good = (F.count(F.lit(1)).over(prices) >= min_prices) & (F.min("_ok").over(prices) == 1)
    return _drop_private(df.withColumn("sigma", F.when(good, F.stddev_samp("_lr").over(rets))))


def minmax_scores(df: DataFrame, columns, n: int = 60) -> DataFrame:
    """Position of the value inside its last ``n`` values mapped to [-1, 1]; 0 for a flat or missing range."""
    out = {}
    for c in columns:
        lo, hi = F.min(c).over(S.frame(n)), F.max(c).over(S.frame(n))
        out[f"{c}_score"] = clip(F.coalesce(F.when(hi - lo > 1e-12, 2 * (F.col(c) - lo) / (hi - lo) - 1), F.lit(0.0)), -1, 1)
    return df.withColumns(out)


def rolling_features_tminus1(bars: DataFrame, min_bars: int = 30) -> DataFrame:
    """Last-row baseline per symbol for the stream: MA gap, volatility, momentum, RSI; null under ``min_bars`` bars."""
    df = base_features(bars).withColumns({"mom_10": S.pct("close", 10), "_n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    last = df.groupBy("symbol").agg(F.max_by(F.struct("date", "close", "ma_20_ratio", "volatility", "mom_10", "rsi", "_n"), "date").alias("z"))
    ok = F.col("z._n") >= min_bars
    return last.select("symbol", F.col("z.date").alias("base_date"), F.col("z.close").alias("base_close"), ok.alias("available"),
                       *[F.when(ok, F.col(f"z.{c}")).alias(c) for c in ("ma_20_ratio", "volatility", "mom_10", "rsi")])
