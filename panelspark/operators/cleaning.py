"""Cleaning, filling, alignment and quality of bar tables."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.windows import Series, clip, finite
from panelspark.schema import required_columns

S = Series()
PRICES = ("open", "high", "low", "close")


def dedupe(df: DataFrame, keys: Sequence[str] = ("symbol", "date"), order: Sequence[str] = ("arrival",), keep: str = "first") -> DataFrame:
    """One row per key, first or last along ``order``.  An aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.min_by if keep == "first" else F.max_by)(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def drop_degenerate(df: DataFrame) -> DataFrame:
    """Drops bars with a non-positive close, high or low, or a high under the low."""
    return df.filter((F.col("close") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("high") >= F.col("low")))


def clip_window(df: DataFrame, start: str | None = None, end: str | None = None, column: str = "date") -> DataFrame:
    """Inclusive date bounds; an empty bound is open."""
    if start:
        df = df.filter(F.col(column) >= F.lit(start).cast("date"))
    if end:
        df = df.filter(F.col(column) <= F.lit(end).cast("date"))
    return df


def min_rows(df: DataFrame, n: int, key: str = "symbol") -> DataFrame:
    """Keeps keys with at least ``n`` rows."""
    return df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select(key), key, "left_semi")


# fixed synonyms of source headers
SYNONYMS = {"日期": "date", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume",
            "Date": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume",
            "月份": "date", "今值": "value"}


def normalise_headers(df: DataFrame, synonyms: dict[str, str] | None = None) -> DataFrame:
    """Renames known headers, coerces numbers, and gives volume-less symbols volume 1."""
    df = df.withColumnsRenamed({k: v for k, v in (synonyms or SYNONYMS).items() if k in df.columns})
    num = [c for c in (*PRICES, "volume", "value") if c in df.columns]
    df = df.withColumns({c: F.col(c).try_cast("double") for c in num})
    if "date" in df.columns:
        df = df.withColumn("date", F.col("date").cast("string").try_cast("date"))
    if "volume" in df.columns and "symbol" in df.columns:
        top = df.groupBy("symbol").agg(F.max("volume").alias("_mv"))
        df = df.join(top, "symbol").withColumn("volume", F.when(F.coalesce(F.col("_mv"), F.lit(0.0)) <= 0, 1.0).otherwise(F.col("volume"))).drop("_mv")
    return df


def coalesce_sources(sources: Sequence[DataFrame], key: str = "symbol") -> DataFrame:
    """Rows of the first source (in order) that has any row of the key."""
    u = None
    for i, s in enumerate(sources):
        s = s.withColumn("priority", F.lit(i))
        u = s if u is None else u.unionByName(s, allowMissingColumns=True)
    best = u.groupBy(key).agg(F.min("priority").alias("priority"))
    return u.join(best, [key, "priority"], "left_semi")


def feature_columns(df: DataFrame, raw: Sequence[str] = ("symbol", "date", "ts", "open", "high", "low", "close", "volume", "amount")) -> list[str]:
    """Feature names: everything but raw bars, targets, labels and private columns; warns on leak-like names."""
    out = [c for c in df.columns if c not in raw and not c.startswith(("target_", "label_", "_"))]
    odd = [c for c in out if any(t in c.lower() for t in ("fwd", "future", "target", "label"))]
    if odd:
        warnings.warn(f"columns look like labels: {odd}", stacklevel=2)
    return out


def fill_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinities to null, carry the last value forward, then 0."""
    past = S.w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({c: finite(c) for c in columns})
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(past), F.lit(0.0)) for c in columns})


def align_features(df: DataFrame, contract: Sequence[str], keep: Sequence[str] = ("symbol", "date"), strict: bool = False) -> DataFrame:
    """Selects features by name in contract order; absent ones are 0 or an error."""
    missing = [c for c in contract if c not in df.columns]
    if missing and strict:
        raise ValueError(f"missing features: {missing}")
    return df.select(*keep, *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in contract])


# Feature families by name prefix (first match wins), then by contained text.
FAMILY_PREFIXES = [
    ("returns", ["ret_"]), ("boll", ["boll_"]), ("ma", ["ma_"]), ("trend_extra", ["ema_", "wma_", "dema_", "tema_", "trima_"]), ("momentum", ["kdj_", "stoch_", "aroon_"]),
    ("factor", ["factor_"]), ("macro", ["macro_"]),
]
FAMILY_TOKENS = [
    ("kama", ["kama"]), ("macd", ["macd"]), ("rsi", ["rsi"]), ("trend_extra", ["adx", "adxr", "vortex_", "trix"]), ("momentum", ["willr", "roc", "mom", "cci", "cmo", "tsi"]),
    ("volatility", ["volatility", "atr", "natr", "stddev", "mass_index", "choppiness", "boll_width"]),
    ("volume", ["volume_ratio", "obv", "vwap", "mfi", "cmf", "ad_line", "pvt", "nvi", "force_index", "eom"]), ("structure", ["pivot", "r1", "s1", "r2", "s2"]),
    ("candle", ["doji", "hammer", "engulfing", "morning_star"]),
]
# Subset name -> families (None: all).
RECIPES = {
    "full": None,
    "no_duplicate_trend": ["returns", "macd", "boll", "rsi", "ma", "kama", "momentum", "volatility", "volume", "structure", "candle", "factor", "macro"],
    "no_ma_family": ["returns", "macd", "boll", "rsi", "kama", "trend_extra", "momentum", "volatility", "volume", "structure", "candle", "factor", "macro"],
    "classic_only": ["returns", "macd", "boll", "rsi", "ma", "volume", "volatility"],
    "compact": ["returns", "rsi", "ma", "volatility", "volume", "factor"],
    "returns_only": ["returns"],
    "no_macro": ["returns", "macd", "boll", "rsi", "ma", "kama", "trend_extra", "momentum", "volatility", "volume", "structure", "candle", "factor"],
    "no_factor": ["returns", "macd", "boll", "rsi", "ma", "kama", "trend_extra", "momentum", "volatility", "volume", "structure", "candle", "macro"],
}


def group_features(features: Sequence[str]) -> dict[str, str]:
    """feature -> family, ``uncovered`` where no rule matches."""
    out = {}
    for f in features:
        low = f.lower()
        fam = next((n for n, ps in FAMILY_PREFIXES if low.startswith(tuple(ps))), None)
        out[f] = fam or next((n for n, ts in FAMILY_TOKENS if any(t in low for t in ts)), "uncovered")
    return out


def feature_family(name: str | Column = "feature") -> Column:
    """The same rules as a column expression."""
    c = F.lower(F.col(name) if isinstance(name, str) else name)
    e = F.lit("uncovered")
    rules = [(n, [c.startswith(p) for p in ps]) for n, ps in FAMILY_PREFIXES] + [(n, [c.contains(t) for t in ts]) for n, ts in FAMILY_TOKENS]
    for n, conds in reversed(rules):
        hit = conds[0]
        for x in conds[1:]:
            hit = hit | x
        e = F.when(hit, n).otherwise(e)
    return e


def subset_features(features: Sequence[str], recipe: str) -> list[str]:
    fams, groups = RECIPES[recipe], group_features(features)
    return [f for f in features if groups[f] != "uncovered" and (fams is None or groups[f] in fams)]


def quality_scores(df: DataFrame, asof: str, columns: Sequence[str] = ("date", *PRICES, "volume")) -> DataFrame:
    """Per symbol: completeness, accuracy, timeliness (0-100), compliance 100 and their mean."""
    comp = [F.avg(F.col(c).isNotNull().cast("double")) for c in columns]
    total = comp[0]
    for c in comp[1:]:
        total = total + c
    g = df.groupBy("symbol").agg(
        (total / len(columns) * 100).alias("completeness"),
        clip(F.coalesce((1 - F.avg((F.col("close") < 0).cast("double")) - F.avg((F.col("close") == 0).cast("double")) * 0.5) * 100, F.lit(0.0)), 0, 100).alias("accuracy"),
        F.coalesce(clip(100 - F.datediff(F.lit(asof).cast("date"), F.max("date")) * 0.5, 0, 100), F.lit(95.0)).alias("timeliness"),
        F.count(F.lit(1)).alias("rows"))
    g = g.withColumn("compliance_score", F.lit(100.0))
    q = (F.col("completeness") + F.col("accuracy") + F.col("timeliness") + F.col("compliance_score")) / 4
    return g.withColumn("quality_score", q).withColumn("level", F.when(q >= 80, "A").otherwise("B"))


def filter_by_quality(df: DataFrame, quality: DataFrame, min_score: float, a_only: bool = False) -> DataFrame:
    good = quality.filter(F.col("quality_score") >= min_score)
    if a_only:
        good = good.filter(F.col("level") == "A")
    return df.join(good.select("symbol"), "symbol", "left_semi")


def pool_coverage(universe: DataFrame, bars: DataFrame, by: str = "asset_class") -> DataFrame:
    """Configured versus present symbols per class, with the missing count and ratio."""
    have = bars.select("symbol").distinct().withColumn("_have", F.lit(1))
    g = universe.join(have, "symbol", "left").groupBy(by).agg(F.count(F.lit(1)).alias("configured"), F.count("_have").alias("present"))
    return g.withColumns({"missing": F.col("configured") - F.col("present"), "coverage": F.col("present") / F.col("configured")})


def calendar_fields(df: DataFrame, ts: str = "ts") -> DataFrame:
    """minute, hour, weekday (Monday = 0), day, month."""
    return df.withColumns({"minute": F.minute(ts), "hour": F.hour(ts), "weekday": F.weekday(ts), "day": F.dayofmonth(ts), "month": F.month(ts)})


def fill_amount(df: DataFrame) -> DataFrame:
    """Missing volume is 0; missing amount is volume times the mean of the four prices."""
    v = F.coalesce(F.col("volume"), F.lit(0.0))
    mean = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    a = F.coalesce(F.col("amount"), v * mean) if "amount" in df.columns else v * mean
    return df.withColumns({"volume": v, "amount": a})


def repair_open(df: DataFrame) -> DataFrame:
    """Strips thousands separators, replaces a zero or missing open by the previous close, fills an absent amount."""
    df = df.withColumns({c: F.regexp_replace(F.col(c).cast("string"), ",", "").try_cast("double") for c in (*PRICES, "volume", "amount") if c in df.columns})
    has_amount = F.max("amount").over(Window.partitionBy("symbol")).isNotNull() if "amount" in df.columns else F.lit(False)
    df = df.withColumns({"_pc": S.lag("close"), "_ha": has_amount})
    amount = F.when(F.col("_ha"), F.col("amount")).otherwise(F.col("close") * F.col("volume")) if "amount" in df.columns else F.col("close") * F.col("volume")
    bad = F.col("open").isNull() | (F.col("open") == 0)
    return df.withColumns({"open": F.when(bad, F.coalesce("_pc", "close")).otherwise(F.col("open")), "amount": amount}).drop("_pc", "_ha")


def window_normalise(df: DataFrame, columns: Sequence[str], n: int, bound: float = 5.0) -> DataFrame:
    """(x - mean) / (population deviation + 1e-5) over the past ``n`` rows, clipped; keeps mean and deviation."""
    df = df.withColumns({f"{c}_mean": S.mean(c, n) for c in columns} | {f"{c}_std": S.std_pop(c, n) for c in columns})
    return df.withColumns({f"{c}_norm": clip((F.col(c) - F.col(f"{c}_mean")) / (F.col(f"{c}_std") + 1e-5), -bound, bound) for c in columns})


def inverse_normalise(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(f"{column}_restored", F.col(f"{column}_norm") * (F.col(f"{column}_std") + 1e-5) + F.col(f"{column}_mean"))


def clamp_path(df: DataFrame, limit: float = 0.1, keys: Sequence[str] = ("symbol", "origin"), start: str = "last_close") -> DataFrame:
    """Each step of a forecast path stays within ``limit`` of the previous clamped price (paths are a few dozen steps)."""
    steps = F.array_sort(F.collect_list(F.struct("step", "price")))
    g = df.groupBy(*keys).agg(F.first(start).alias(start), steps.alias("_s"))

    def advance(acc, x):
        prev = F.when(F.size(acc) == 0, F.col(start)).otherwise(F.try_element_at(acc, F.lit(-1))["price"])
        p = F.greatest(prev * (1 - limit), F.least(prev * (1 + limit), x["price"]))
        return F.array_append(acc, F.struct(x["step"].alias("step"), p.alias("price")))

    folded = F.aggregate("_s", F.expr("cast(array() as array<struct<step:int,price:double>>)"), advance)
    return g.select(*keys, F.explode(folded).alias("_x")).select(*keys, F.col("_x.step").alias("step"), F.col("_x.price").alias("price"))


def business_days(df: DataFrame, date: str, n: int, holidays: DataFrame | None = None) -> DataFrame:
    """The ``n`` business days after ``date`` of every row (n is small), skipping weekends and holidays, however dense these are.

    The window holds n weekdays and one more for every holiday that falls on a weekday, so n days are left in it whatever the holidays.
    """
    off = None if holidays is None else holidays.select(F.col("date").cast("date").alias("day")).where((F.weekday("day") < 5)).distinct()
    more = 0 if off is None else off.count()  # a calendar, one row a day
    span = -(-(n + more) // 5) * 7 + 7
    d = df.withColumn("day", F.explode(F.sequence(F.date_add(date, 1), F.date_add(date, span)))).filter(F.weekday("day") < 5)
    if off is not None:
        d = d.join(off, "day", "left_anti")
    w = Window.partitionBy(*df.columns).orderBy("day")
    return d.withColumn("step", F.row_number().over(w)).filter(F.col("step") <= n)


def clean_bars(df: DataFrame, keep: str = "first") -> DataFrame:
    """Degenerate rows out, then one bar per (symbol, date)."""
    required_columns(df, ("symbol", "date", "arrival", *PRICES))
    return dedupe(drop_degenerate(df), order=("arrival",), keep=keep)
