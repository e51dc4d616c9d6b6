"""Scalar functions as column expressions, and their SQL registration."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.windows import clip, col, finite

# fixed values: exchange suffixes and code prefixes of the asset classes
CN, FUTURES, FOREX = ("SH", "SZ", "BJ"), ("SHF", "DCE", "CZC", "INE", "CFE", "GFEX"), ("FXCM", "FX", "FOREX")
ETF_CODES, STOCK_CODES, CONVERTIBLE_CODES = ("51", "56", "58", "159"), ("60", "68", "00", "30"), ("11", "12")
SPLIT_ETF = ("51", "52", "56", "58", "15", "16", "159", "588")
SPLIT_FUTURES = (".SHF", ".INE", ".DCE", ".CZC", ".CFX")


def normalise_symbol(c="symbol") -> Column:
    return F.upper(F.trim(F.coalesce(col(c), F.lit(""))))


def symbol_code(c="symbol") -> Column:
    return F.regexp_extract(normalise_symbol(c), r"^([0-9A-Z]+)(\.([A-Z]+))?$", 1)


def symbol_suffix(c="symbol") -> Column:
    return F.regexp_extract(normalise_symbol(c), r"^([0-9A-Z]+)(\.([A-Z]+))?$", 3)


def _starts(c: Column, prefixes: Sequence[str]) -> Column:
    return c.rlike("^(" + "|".join(prefixes) + ")")


def asset_class(c="symbol") -> Column:
    """stock, etf, futures, forex, convertible or unknown, by suffix and code prefix."""
    code, suf = symbol_code(c), symbol_suffix(c)
    return (F.when(code == "", "unknown").when(suf.isin(*FUTURES), "futures").when(suf.isin(*FOREX), "forex")
            .when((suf != "") & ~suf.isin(*CN), "unknown").when(_starts(code, ETF_CODES), "etf").when(_starts(code, STOCK_CODES), "stock")
            .when(_starts(code, CONVERTIBLE_CODES) & (F.length(code) == 6), "convertible").otherwise("unknown"))


def coarse_class(c="symbol") -> Column:
    """etf, stock, futures, forex or other, by the coarser pool rules."""
    s = col(c)
    fut = s.rlike("(" + "|".join(x.replace(".", r"\.") for x in SPLIT_FUTURES) + ")$")
    return (F.when(s.endswith(".FXCM"), "forex").when(fut, "futures").when(_starts(s, SPLIT_ETF), "etf")
            .when(s.rlike(r"\.(SH|SZ)$"), "stock").otherwise("other"))


def market_code(c="symbol") -> Column:
    """Lower-case market prefix plus code for .SH/.SZ symbols, null otherwise."""
    s = normalise_symbol(c)
    return F.when(s.rlike(r"\.(SH|SZ)$"), F.concat(F.lower(F.right(s, F.lit(2))), F.substring_index(s, ".", 1)))


def continuous_contract(c="symbol") -> Column:
    """Main-contract code of a futures symbol, null otherwise."""
    s = normalise_symbol(c)
    return F.when(F.substring_index(s, ".", -1).isin(*FUTURES) & s.contains("."), F.concat(F.substring_index(s, ".", 1), F.lit("0")))


def clean_text(c) -> Column:
    """Keeps CJK and ASCII letters and digits, collapses all between them to one blank."""
    return F.regexp_replace(F.trim(col(c)), "[^一-龥a-zA-Z0-9]+", " ")


def clean_length(c) -> Column:
    """Length of ``clean_text``: one other character is one blank, so only runs of them are replaced."""
    return F.length(F.regexp_replace(F.trim(col(c)), "[^一-龥a-zA-Z0-9]{2,}", " "))


def lexicon_sentiment(text, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """struct(sentiment, positive_score, negative_score) by distinct contained words of the cleaned text.

    A word of kept characters alone stands in the cleaned text just where it stands in the text, so only other words need the cleaning.  The steps are lambdas
    over arrays of one element, so that text and counts are evaluated once a row.
    """
    plain = all(re.fullmatch("[一-龥a-zA-Z0-9]+", w) for w in (*positive, *negative))

    def hits(t, words):
        return sum((F.when(t.contains(w), 1).otherwise(0) for w in words), F.lit(0))

    def scores(h):
        p, n = h["p"], h["n"]
        tot = F.nullif(p + n, F.lit(0))
        return F.struct(F.coalesce((p - n) / tot, F.lit(0.0)).alias("sentiment"), F.coalesce(p / tot, F.lit(0.0)).alias("positive_score"),
                        F.coalesce(n / tot, F.lit(0.0)).alias("negative_score"))

    found = F.transform(F.array(col(text) if plain else clean_text(text)), lambda t: F.struct(hits(t, positive).alias("p"), hits(t, negative).alias("n")))
    return F.get(F.transform(found, scores), F.lit(0))


def net_up_probability(direction, p) -> Column:
    """P(up) from a direction label and the probability of that direction."""
    d, p = F.lower(col(direction)), col(p)
    return F.when(p.isNull() | (p < 0) | (p > 1), None).when(d.isin("up", "bullish", "long"), p).when(d.isin("down", "bearish", "short"), 1 - p).otherwise(0.5)


def confidence(p) -> Column:
    return 2 * F.abs(col(p) - 0.5)


def interval_confidence(lo, hi) -> Column:
    lo, hi = col(lo), col(hi)
    return clip(1 - (hi - lo) / F.nullif(F.abs((lo + hi) / 2), F.lit(0.0)), 0, 1)


def direction_score(p) -> Column:
    return clip(2 * (col(p) - 0.5), -1, 1)


def logistic(x, scale: float = 1.0, center: float = 0.0) -> Column:
    return 1 / (1 + F.exp(-clip(scale * (col(x) - center), -30, 30)))


def tanh_squash(x, scale: float = 1.0) -> Column:
    return F.tanh(F.coalesce(finite(col(x)), F.lit(0.0)) / scale)


def normal_cdf(x) -> Column:
    """Standard normal distribution by the series of the error function (small |x|) or a continued fraction (tails)."""
    z = F.abs(col(x))
    t = z * z

    def down(n):
        return F.sequence(F.lit(n), F.lit(1), F.lit(-1))

    series = F.aggregate(down(60), F.lit(1.0), lambda a, k: 1 + t * a / (2 * k + 1))  # sum z^2k / (1*3*5*...), Horner form
    pdf = F.exp(-t / 2) / 2.5066282746310002
    far = F.greatest(z, F.lit(1.0))  # the fraction only serves z >= 4
    frac = F.aggregate(down(40), far, lambda a, k: far + k / a)
    tail = F.when(z < 4, 0.5 - pdf * z * series).otherwise(pdf / frac)
    return F.when(col(x) >= 0, 1 - tail).otherwise(tail)


# fixed values: coefficients of Acklam's inverse normal approximation
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)


def _poly(cs, x):
    out = F.lit(cs[0])
    for c in cs[1:]:
        out = out * x + c
    return out


def normal_ppf(p) -> Column:
    """Inverse normal distribution (relative error about 1e-9)."""
    p = col(p)
    q, lo, hi = p - 0.5, F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    r = q * q
    mid = _poly(_A, r) * q / (_poly(_B, r) * r + 1)
    low, high = _poly(_C, lo) / (_poly(_D, lo) * lo + 1), -_poly(_C, hi) / (_poly(_D, hi) * hi + 1)
    return F.when((p <= 0) | (p >= 1), None).when(p < 0.02425, low).when(p > 1 - 0.02425, high).otherwise(mid)


def two_sided_p(z) -> Column:
    return 2 * (1 - normal_cdf(F.abs(col(z))))


def fingerprint(m: str | Column, n: int = 16) -> Column:
    """First ``n`` hex digits of the SHA-256 of a map's key-sorted JSON."""
    entries = F.array_sort(F.map_entries(col(m)))
    return F.substring(F.sha2(F.to_json(F.map_from_entries(entries)), 256), 1, n)


def trading_hours(ts) -> Column:
    """Weekday sessions 09:30-11:30 and 13:00-15:00, inclusive."""
    t = col(ts)
    m = F.hour(t) * 60 + F.minute(t)
    return (F.weekday(t) < 5) & (m.between(570, 690) | m.between(780, 900))


def age_days(d, asof: str) -> Column:
    return F.datediff(F.lit(asof).cast("date"), col(d))


def dig(json_text, path: str) -> Column:
    """Dotted path into a JSON text."""
    return F.get_json_object(col(json_text), "$." + path)


def decode_lines(df: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON lines to columns; malformed lines are dropped."""
    p = df.withColumn("_j", F.from_json(column, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return p.filter(F.col("_j").isNotNull() & F.col("_j._bad").isNull()).select(*df.columns, "_j.*").drop("_bad")


def weighted_blend(components: dict[str, float]) -> Column:
    """Null-aware weighted mean: weights re-normalise over the components present."""
    num, den = F.lit(0.0), F.lit(0.0)
    for name, w in components.items():
        ok = F.col(name).isNotNull()
        num, den = num + F.when(ok, F.col(name) * w).otherwise(0.0), den + F.when(ok, w).otherwise(0.0)
    return F.when(den > 0, num / F.nullif(den, F.lit(0.0)))


# SQL bodies of the functions callable from SQL text
SQL_FUNCTIONS = {
    "panel_normalise_symbol": ("s string", "string", "upper(trim(coalesce(s, '')))"),
    "panel_confidence": ("p double", "double", "2 * abs(p - 0.5)"),
    "panel_direction_score": ("p double", "double", "greatest(-1d, least(1d, 2 * (p - 0.5)))"),
    "panel_logistic": ("x double", "double", "1 / (1 + exp(-greatest(-30d, least(30d, x))))"),
    "panel_trading_hours": ("t timestamp", "boolean",
                            "weekday(t) < 5 and (hour(t) * 60 + minute(t) between 570 and 690 or hour(t) * 60 + minute(t) between 780 and 900)"),
    "panel_age_days": ("d date, asof date", "int", "datediff(asof, d)"),
    "panel_market_code": ("s string", "string",
                          "case when upper(trim(s)) rlike '[.](SH|SZ)$' then concat(lower(right(upper(trim(s)), 2)), substring_index(upper(trim(s)), '.', 1)) end"),
    "panel_net_up": ("direction string, p double", "double",
                     "case when p is null or p < 0 or p > 1 then null when lower(direction) in ('up','bullish','long') then p when lower(direction) in ('down','bearish','short') then 1 - p else 0.5d end"),
}


def register_sql(spark: SparkSession) -> list[str]:
    """Makes the scalar set callable from SQL text as temporary SQL functions (inlined by Catalyst, no UDF)."""
    for name, (args, ret, body) in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({args}) returns {ret} return {body}")
    return list(SQL_FUNCTIONS)
