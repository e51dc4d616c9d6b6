"""Factor columns: bounded single factors by family, the rolling factor matrix, and factor blending."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.order_stats import spearman
from panelspark.operators.recursion import ewm, with_recursive
from panelspark.operators.windows import Series, by_series, clip, finite, nonzero, pearson
from panelspark.schema import required_columns

S = Series()

FAMILIES = {  # fixed names of the factor families
    "trend": ("factor_ma_bias", "factor_ema_slope", "factor_adx_strength"),
    "momentum": ("factor_rsi_score", "factor_roc", "factor_macd_hist"),
    "volatility": ("factor_volatility", "factor_atr_ratio"),
    "volume": ("factor_volume_ratio", "factor_obv_slope", "factor_cmf"),
    "reversal": ("factor_boll_revert", "factor_kdj_score"),
    "sentiment": ("factor_sentiment",),
    "macro": ("factor_macro",),
}


def squash(c: Column) -> Column:
    """tanh with missing or infinite input as 0."""
    return F.tanh(F.coalesce(finite(c), F.lit(0.0)))


def _null0(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != 0, c)


def _smoothed(df: DataFrame, columns: Sequence[str], smoothing: int) -> DataFrame:
    df = df.withColumns({f"{c}__a": F.avg(c).over(S.frame(smoothing)) for c in columns})
    return df.withColumns({c: clip(F.coalesce(finite(f"{c}__a"), F.lit(0.0)), -1, 1) for c in columns}).drop(*[f"{c}__a" for c in columns])


def price_factors(bars: DataFrame, smoothing: int = 5, z_window: int = 252, n: int = 14) -> DataFrame:
    """Trend, momentum, volatility, volume and reversal factors, each squashed, smoothed and clipped to [-1, 1]."""
    required_columns(bars, ("symbol", "date", "open", "high", "low", "close", "volume"))
    base = bars.columns
    c, h, lo, v = F.col("close"), F.col("high"), F.col("low"), F.col("volume")

    def rec(p: pd.DataFrame) -> dict[str, pd.Series]:
        fast, slow = ewm(p["close"], span=12), ewm(p["close"], span=26)
        macd = fast - slow
        lo9, hi9 = p["low"].rolling(9, min_periods=3).min(), p["high"].rolling(9, min_periods=3).max()
        rng = hi9 - lo9
        k = ewm((p["close"] - lo9) / rng.where(rng != 0) * 100, alpha=1 / 3)
        return {"_slope": fast / slow - 1, "_mh": macd - ewm(macd, span=9), "_j": 3 * k - 2 * ewm(k, alpha=1 / 3)}

    df = with_recursive(bars, rec, ["_slope", "_mh", "_j"])
    df = df.withColumns({"_d": S.diff("close"), "_up": S.diff("high"), "_dn": -S.diff("low"), "_pc": S.lag("close"), "_ret": S.pct("close")})
    df = df.withColumns({
        "_tr": F.greatest(h - lo, F.abs(h - F.col("_pc")), F.abs(lo - F.col("_pc"))),
        "_pdm": F.when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0),
        "_mdm": F.when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn")).otherwise(0.0),
        "_obv": S.cumsum(F.signum(F.coalesce("_d", F.lit(0.0))) * v),
        "_mfv": F.coalesce((2 * c - lo - h) / _null0(h - lo), F.lit(0.0)) * v,
        "_vol": S.std("_ret", 20, 5),
        "_g": S.mean(F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0))), n, 5),
        "_l": S.mean(F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0))), n, 5),
    })
    df = df.withColumns({
        "_atr": S.mean("_tr", n, 5), "_pdi": 100 * S.mean("_pdm", n, 5), "_mdi": 100 * S.mean("_mdm", n, 5),
        "_obv5": F.coalesce(S.diff("_obv", 5), F.lit(0.0)), "_ma": S.mean("close", 20, 5), "_sd": S.std("close", 20, 5),
    })
    df = df.withColumns({"_p": F.col("_pdi") / _null0("_atr"), "_m": F.col("_mdi") / _null0("_atr")})
    df = df.withColumns({"_dx": 100 * F.abs(F.col("_p") - F.col("_m")) / _null0(F.col("_p") + F.col("_m")),
                         "_natr": -(F.col("_atr") / (F.abs(c) + 1e-9))})
    df = S.with_zscore(df, ["_vol", "_natr", "_obv5"], z_window, 5)
    df = df.withColumns({"_adx": S.mean("_dx", n, 5), "_c20": S.pct("close", 20), "_v20": S.mean("volume", 20, 5),
                         "_mfv20": S.sum("_mfv", 20, 5), "_vs20": S.sum("volume", 20, 5)})
    df = df.withColumns({
        "factor_ma_bias": squash((c / F.col("_ma") - 1) * 10),
        "factor_ema_slope": squash(F.col("_slope") * 15),
        "factor_adx_strength": squash(F.signum(F.coalesce(F.col("_p") - F.col("_m"), F.lit(0.0)))
                                      * F.coalesce("_adx", F.lit(0.0)) / 50 * 2),
        "factor_rsi_score": squash((100 - 100 / (1 + F.col("_g") / (F.col("_l") + 1e-9)) - 50) / 25),
        "factor_roc": squash(F.col("_c20") * 10),
        "factor_macd_hist": squash(F.col("_mh") / (F.abs(c) + 1e-9) * 200),
        "factor_volatility": F.tanh(-F.col("_vol_z")),
        "factor_atr_ratio": F.tanh("_natr_z"),
        "factor_volume_ratio": squash(v / _null0("_v20") - 1),
        "factor_obv_slope": F.tanh("_obv5_z"),
        "factor_cmf": squash(F.col("_mfv20") / _null0("_vs20")),
        "factor_boll_revert": squash(-(c - F.col("_ma")) / (2 * F.col("_sd") + 1e-9)),
        "factor_kdj_score": squash(-(F.coalesce(F.col("_j"), F.lit(50.0)) - 50) / 50),
    })
    names = [n for f in ("trend", "momentum", "volatility", "volume", "reversal") for n in FAMILIES[f]]
    return _smoothed(df, names, smoothing).select(*base, *names)


def sentiment_factor(df: DataFrame, column: str = "sentiment_score", smoothing: int = 5) -> DataFrame:
    """Squashed sentiment column, neutral 0 where the column or value is absent."""
    x = squash(F.col(column).cast("double")) if column in df.columns else F.lit(0.0)
    return _smoothed(df.withColumn("factor_sentiment", x), ["factor_sentiment"], smoothing)


def macro_factor(df: DataFrame, prefix: str = "macro_", z_window: int = 252, smoothing: int = 5) -> DataFrame:
    """Mean rolling z-score of the macro columns that are not all zero for the symbol."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    if not cols:
        return df.withColumn("factor_macro", F.lit(0.0))
    whole = Window.partitionBy("symbol")
    df2 = S.with_zscore(df, cols, z_window, 5)
    df2 = df2.withColumns({f"_z{i}": F.when(F.sum(F.abs(c)).over(whole) != 0, F.col(f"{c}_z")) for i, c in enumerate(cols)})
    zs = [F.col(f"_z{i}") for i in range(len(cols))]
    n = reduce(lambda a, b: a + b, [z.isNotNull().cast("int") for z in zs])
    total = reduce(lambda a, b: a + b, [F.coalesce(z, F.lit(0.0)) for z in zs])
    df2 = df2.withColumn("factor_macro", squash(F.when(n > 0, total / n)))
    return _smoothed(df2, ["factor_macro"], smoothing).select(*df.columns, "factor_macro")


# ---- rolling factor matrix
WINDOWS = (5, 10, 20, 30, 60)
KBAR = ("KMID", "KLEN", "KUP", "KLOW", "KSFT", "KMID2", "KUP2", "KLOW2")
ROLLING = ("ROC", "MA", "STD", "BETA", "RSQR", "RESI", "QTLU", "QTLD", "RANK", "RSV", "CORR", "CORD", "CNTP", "SUMP", "VSUMP",
           "VMA", "VSTD", "WVMA")


def _safe(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > 1e-12, a / b)


def factor_matrix(bars: DataFrame, windows: Sequence[int] = WINDOWS, prefix: str = "A158_") -> DataFrame:
    """8 candle columns and 18 rolling columns per window (98 for the default windows)."""
    base = bars.columns
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    top, bot, mid = F.greatest(o, c), F.least(o, c), (h + lo) / 2
    k = {"KMID": _safe(c - o, o), "KLEN": _safe(h - lo, o), "KUP": _safe(h - top, o), "KLOW": _safe(bot - lo, o),
         "KSFT": _safe(c / 2 + o / 2 - h, o), "KMID2": _safe(c - o, mid), "KUP2": _safe(h - top, mid), "KLOW2": _safe(bot - lo, mid)}
    df = by_series(bars).withColumns({"_rn": S.row(), "_pc": S.lag("close"), "_pv": S.lag("volume"),
                           **{f"_c{w}": S.lag("close", w) for w in windows}, **{prefix + n: e for n, e in k.items()}})
    df = df.withColumns({
        "_av": finite(F.abs(c / F.col("_pc") - 1) * v), "_g": F.when(F.col("_pc").isNotNull(), F.greatest(c - F.col("_pc"), F.lit(0.0))),
        "_vg": F.when(F.col("_pv").isNotNull(), F.greatest(v - F.col("_pv"), F.lit(0.0))),
        **{f"_a{w}": F.when(F.col("_rn") >= w, F.array_sort(F.collect_list("close").over(S.frame(w)))) for w in windows},
        **{f"_s{w}": F.when(F.col("_rn") >= w, F.regr_slope("close", "_rn").over(S.frame(w))) for w in windows},
    })

    def quant(a: str, w: int, q: float) -> Column:
        pos = q * (w - 1)
        i = int(pos)
        x, y = F.get(F.col(a), F.lit(i)), F.get(F.col(a), F.lit(min(i + 1, w - 1)))
        return x + (y - x) * (pos - i)

    out = {}
    for w in windows:
        fr, full = S.frame(w), F.col("_rn") >= w
        ma, a, pw = S.mean("close", w), F.col(f"_a{w}"), F.col(f"_c{w}")
        below, ties = F.size(F.filter(a, lambda x: x < c)), F.size(F.filter(a, lambda x: x == c))
        hh, ll = S.max("high", w), S.min("low", w)
        out |= {
            f"ROC{w}": _safe(pw, c), f"MA{w}": ma, f"STD{w}": S.std("close", w), f"BETA{w}": F.col(f"_s{w}"),
            f"RSQR{w}": F.when(full & (F.get(a, F.lit(0)) < F.get(a, F.lit(w - 1))), F.regr_r2("close", "_rn").over(fr)),
            f"RESI{w}": c - ma - F.col(f"_s{w}") * (w - 1) / 2,
            f"QTLU{w}": quant(f"_a{w}", w, 0.8), f"QTLD{w}": quant(f"_a{w}", w, 0.2), f"RANK{w}": (below + (ties + 1) / 2) / w,
            f"RSV{w}": _safe(c - ll, hh - ll), f"CORR{w}": F.when(full, pearson("close", "volume", fr)),
            f"CORD{w}": F.when(F.col("_rn") >= 2 * w, pearson(c - pw, "volume", fr)),
            f"CNTP{w}": F.when(full, F.avg(F.when(c > pw, 1.0).otherwise(0.0)).over(fr)), f"SUMP{w}": S.sum("_g", w),
            f"VSUMP{w}": S.sum("_vg", w), f"VMA{w}": S.mean("volume", w), f"VSTD{w}": S.std("volume", w), f"WVMA{w}": S.std("_av", w),
        }
    df = df.withColumns({prefix + n: e for n, e in out.items()}).withColumns({prefix + n: finite(prefix + n) for n in out})
    return df.select(*base, *[prefix + n for n in k], *[prefix + n for n in out])


# fixed membership of the compressed families: (sign, rolling stems, candle columns)
COMPRESSED = {
    "momentum": [(-1.0, ("ROC",), ())],
    "trend": [(1.0, ("MA", "RSV", "RANK"), ())],
    "volatility": [(-1.0, ("STD", "WVMA", "VSTD"), ())],
    "volume": [(1.0, ("CORR", "CNTP", "VMA", "SUMP", "VSUMP"), ())],
    "reversal": [(-1.0, ("QTLU",), ("KUP", "KUP2")), (1.0, ("QTLD",), ("KLOW", "KLOW2"))],
}


def compressed_factors(bars: DataFrame, windows: Sequence[int] = WINDOWS, z_window: int = 120, min_periods: int = 20,
                       min_rows: int = 60) -> DataFrame:
    """Five family scores: mean signed rolling z-score of the member columns, squashed; neutral for short series."""
    members = [f"A158_{s}{w}" for parts in COMPRESSED.values() for _, stems, _ in parts for s in stems for w in windows]
    members += [f"A158_{x}" for parts in COMPRESSED.values() for _, _, ks in parts for x in ks]
    m = S.with_zscore(factor_matrix(bars, windows), members, z_window, min_periods)
    exprs = {}
    for fam, parts in COMPRESSED.items():
        terms = []
        for sign, stems, ks in parts:
            for col in [f"A158_{s}{w}" for s in stems for w in windows] + [f"A158_{x}" for x in ks]:
                terms.append(F.col(f"{col}_z") * sign)
        exprs[f"factor_a158_{fam}"] = reduce(lambda a, b: a + b, terms) / len(terms)
    enough = F.count(F.lit(1)).over(Window.partitionBy("symbol")) >= min_rows
    m = m.withColumn("factor_a158_available", F.when(enough, 1.0).otherwise(0.0))
    m = m.withColumns(exprs)
    names = list(exprs)
    m = m.withColumns({n: F.when(F.col("factor_a158_available") == 1, squash(F.col(n))).otherwise(0.0) for n in names})
    return m.select(*bars.columns, *names, "factor_a158_available")


# ---- blending
def to_long(df: DataFrame, factors: Sequence[str], keep: Sequence[str] = ("symbol", "date")) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("value")) for f in factors])).alias("_z")).select(
        *keep, F.col("_z.factor").alias("factor"), F.col("_z.value").alias("value"))


def resolve_weights(available: DataFrame, prior: dict[str, float], keys: Sequence[str], ic: DataFrame | None = None) -> DataFrame:
    """Static or |IC|-scaled weights re-normalised over the factors present per key; equal weights if all are zero."""
    p = F.create_map(*[F.lit(x) for kv in prior.items() for x in kv])
    df = available.withColumn("_w", F.coalesce(F.try_element_at(p, F.col("factor")), F.lit(0.0)))
    if ic is not None:
        df = df.join(ic.select("factor", F.abs("ic").alias("_ic")), "factor", "left").withColumn("_w", F.coalesce("_ic", F.lit(0.0)) * F.col("_w"))
    w = Window.partitionBy(*keys)
    pos = F.when(F.col("_w") > 0, F.col("_w")).otherwise(0.0)
    total, n = F.sum(pos).over(w), F.count(F.lit(1)).over(w)
    return df.withColumn("weight", F.when(total > 0, pos / total).otherwise(1 / n)).drop("_w", "_ic")


def combine(scores: DataFrame, prior: dict[str, float], keys: Sequence[str] = ("symbol",), band: float = 0.05) -> DataFrame:
    """Weighted blend of long (key, factor, value): score, p_up, direction and coverage-scaled confidence."""
    have = scores.filter(F.col("value").isNotNull())
    counts = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"), F.count("value").alias("n_available"))
    w = resolve_weights(have.withColumn("value", clip("value", -1, 1)), prior, keys)
    g = w.groupBy(*keys).agg(F.sum(F.col("value") * F.col("weight")).alias("score"))
    df = counts.join(g, list(keys), "left").withColumn("score", clip(F.coalesce("score", F.lit(0.0)), -1, 1))
    s = F.col("score")
    return df.select(*keys, "score", (0.5 + s / 2).alias("p_up"), (F.col("_all") - F.col("n_available")).alias("n_missing"),
                     F.when(s > band, "up").when(s < -band, "down").otherwise("neutral").alias("direction"),
                     F.abs(s).alias("confidence"))


def factor_weights(ic: DataFrame, top_n: int = 8, min_abs_ic: float = 0.005, shrink: float = 0.35) -> DataFrame:
    """(factor, family, ic) -> weight: top factors per family above a floor, shrunk to equal, times family strength.

    The input has one row per factor, so its windows are over a handful of rows per family.
    """
    fam = Window.partitionBy("family")
    order = fam.orderBy(F.desc("_a"), "factor")
    df = ic.withColumn("_a", F.abs("ic")).withColumn("_rk", F.row_number().over(order))
    df = df.withColumn("_any", F.max((F.col("_a") >= min_abs_ic).cast("int")).over(fam))
    picked = F.when(F.col("_any") == 1, (F.col("_a") >= min_abs_ic) & (F.col("_rk") <= top_n)).otherwise(F.col("_rk") == 1)
    df = df.withColumn("_p", picked).withColumn("_v", F.when(F.col("_p") & (F.col("_a") > 0), F.col("_a")))
    df = df.withColumns({"_sum": F.sum("_v").over(fam), "_n": F.count("_v").over(fam), "_np": F.sum(F.col("_p").cast("int")).over(fam),
                         "_strength": F.max("_a").over(fam)})
    within = F.when(F.col("_n") > 0, (1 - shrink) * F.col("_v") / F.col("_sum") + shrink / F.col("_n")).when(F.col("_p"), 1 / F.col("_np"))
    df = df.withColumn("_within", F.coalesce(within, F.lit(0.0))).withColumn("_wsum", F.sum("_within").over(fam))
    strength = df.groupBy("family").agg(F.max("_a").alias("_fs")).agg(F.sum("_fs").alias("_total"), F.count(F.lit(1)).alias("_nf"))
    df = df.join(F.broadcast(strength))  # a single row
    fw = F.when(F.col("_total") > 0, F.col("_strength") / F.col("_total")).otherwise(1 / F.col("_nf"))
    df = df.withColumn("_f", fw * F.coalesce(F.col("_within") / _null0("_wsum"), F.lit(0.0)))
    total = df.groupBy().agg(F.sum("_f").alias("_ft"))
    return df.join(F.broadcast(total)).select("factor", "family", "ic", fw.alias("family_weight"),
                                              (F.col("_f") / nonzero("_ft", 1.0)).alias("weight"))


def factor_ic(panel: DataFrame, factors: Sequence[str], target: str, bounded: bool = False) -> DataFrame:
    """Rank correlation of every factor with the target, all factors in one pass."""
    long = to_long(panel.withColumns({f: F.coalesce(finite(f), F.lit(0.0)) for f in factors}), factors, keep=("symbol", "date", target))
    return spearman(long, ["factor"], "value", target, bounded=bounded)
