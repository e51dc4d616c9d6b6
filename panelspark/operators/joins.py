"""As-of, interval and positional joins of panel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.order_stats import bucketed, join_same
from panelspark.operators.windows import Series


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, columns: Sequence[str],
              tie: str | None = None, small: bool = False) -> DataFrame:
    """Latest right row at or before each left row, per ``keys`` (which may be empty).

    Both sides are unioned and cut into time buckets; the last right row of each bucket is carried to the following
    buckets, so no key is handled by a single task (``small=True``: a key's rows are few by contract).  Null keys match null keys.  Columns come back as ``asof_<name>`` plus ``asof_<on>``.
    """
    val = F.struct(on, *([tie] if tie else []), *[c for c in columns if c != tie])
    r = right.select(*keys, on, val.alias("_r"), F.lit(0).alias("_side"))
    lf = left.withColumn("_l", F.struct(*left.columns)).select(*keys, on, "_l", F.lit(1).alias("_side"))
    u = lf.unionByName(r, allowMissingColumns=True)
    ks = list(keys) or ["_all"]
    if small:
        w = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
        out = u.withColumn("_hit", F.max("_r").over(w))
    else:
        b = bucketed(u, keys, [on])
        last = b.groupBy(*ks, "_b").agg(F.max("_r").alias("_last"))
        prev = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carry = last.select(*ks, "_b", F.max("_last").over(prev).alias("_carry"))
        w = Window.partitionBy(*ks, "_b").orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
        out = join_same(b, carry, [*ks, "_b"]).withColumn("_hit", F.coalesce(F.max("_r").over(w), "_carry"))
    out = out.filter(F.col("_side") == 1)
    return out.select("_l.*", F.col(f"_hit.{on}").alias(f"asof_{on}"), *[F.col(f"_hit.{c}").alias(f"asof_{c}") for c in columns])


def macro_features(macro: DataFrame) -> DataFrame:
    """Release table with latest value, change to the previous release and mean of the last three."""
    s = Series(keys=("indicator",))
    return macro.select("indicator", "date", F.col("value").alias("latest"), (F.col("value") - s.lag("value")).alias("mom"),
                        F.avg("value").over(s.w.rowsBetween(-2, 0)).alias("yoy3"))


def attach_macro(bars: DataFrame, macro: DataFrame, indicators: Sequence[str]) -> DataFrame:
    """As-of macro columns on bars: resolved once per distinct date, then joined back by date; absent values are 0."""
    days = bars.select("date").distinct()
    grid = days.withColumn("indicator", F.explode(F.array(*[F.lit(i) for i in indicators])))
    hit = asof_join(grid, macro_features(macro), ["indicator"], "date", ["latest", "mom", "yoy3"], small=True)
    wide = hit.groupBy("date").pivot("indicator", list(indicators)).agg(
        F.first("asof_latest").alias("latest"), F.first("asof_mom").alias("mom"), F.first("asof_yoy3").alias("yoy3"))
    cols = [c for c in wide.columns if c != "date"]
    wide = wide.select("date", *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias("macro_" + c.lower().replace("-", "_").replace(" ", "_")) for c in cols])
    return bars.join(wide, "date")


def macro_vector(macro: DataFrame, asof: str) -> DataFrame:
    """Macro features per indicator at one date; no fallback to later releases."""
    m = macro_features(macro).filter(F.col("date") <= F.lit(asof).cast("date"))
    g = m.groupBy("indicator").agg(F.max_by(F.struct("date", "latest", "mom", "yoy3"), "date").alias("_m"))
    return g.select("indicator", F.col("_m.date").alias("date"), F.col("_m.latest").alias("latest"),
                    F.coalesce("_m.mom", F.lit(0.0)).alias("mom"), F.col("_m.yoy3").alias("yoy3"))


def tolerant_match(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, columns: Sequence[str], max_lag: int) -> DataFrame:
    """As-of join that accepts a match at most ``max_lag`` days old."""
    j = asof_join(left, right, keys, on, columns)
    ok = F.datediff(on, f"asof_{on}") <= max_lag
    return j.withColumns({c: F.when(ok, F.col(c)) for c in j.columns if c.startswith("asof_")})


def attach_sentiment(bars: DataFrame, daily: DataFrame) -> DataFrame:
    """Left join of the daily sentiment with neutral defaults."""
    defaults = {"sentiment_mean": 0.0, "sentiment_std": 0.0, "positive_mean": 0.5, "negative_mean": 0.5, "news_count": 0}
    j = bars.join(daily, "date", "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def align_horizons(scores: DataFrame, horizons: Sequence[int], value: str = "p_up") -> DataFrame:
    """One row per (date, symbol) with a column per horizon, only where every horizon is present."""
    w = scores.groupBy("date", "symbol").pivot("horizon", list(horizons)).agg(F.first(value))
    return w.withColumnsRenamed({str(h): f"{value}_{h}" for h in horizons}).dropna(subset=[f"{value}_{h}" for h in horizons])


def common_dates(plans: DataFrame, min_dates: int = 3) -> DataFrame:
    """Dates on which every symbol of the plan has a row; empty when fewer than ``min_dates``."""
    n = plans.agg(F.count_distinct("symbol").alias("_n"))
    d = plans.groupBy("date").agg(F.count_distinct("symbol").alias("_k")).join(F.broadcast(n))  # one row
    d = d.filter(F.col("_k") == F.col("_n")).select("date")
    enough = d.agg((F.count(F.lit(1)) >= min_dates).alias("_ok"))
    return d.join(F.broadcast(enough)).filter("_ok").select("date")


def verify_predictions(predictions: DataFrame, bars: DataFrame, asof: str | None = None, mode: str = "row") -> DataFrame:
    """Realised return of each prediction: the bar ``horizon`` rows later, or (``to_asof``) the last bar up to ``asof``."""
    s = Series()
    b = bars.select("symbol", F.col("date").alias("_d"), "close")
    if mode == "row":
        pos = b.withColumn("_p", F.row_number().over(Window.partitionBy("symbol").orderBy("_d")))
        start = pos.select("symbol", F.col("_d").alias("latest_date"), F.col("_p").alias("_p0"))
        end = pos.select("symbol", F.col("_p").alias("_pe"), F.col("close").alias("exit_close"), F.col("_d").alias("exit_date"))
        j = predictions.join(start, ["symbol", "latest_date"], "left").withColumn("_pe", F.col("_p0") + F.col("horizon"))
        j = j.join(end, ["symbol", "_pe"], "left").drop("_p0", "_pe")
    else:
        upto = b.filter(F.col("_d") <= F.lit(asof).cast("date"))
        last = upto.groupBy("symbol").agg(F.max_by("close", "_d").alias("exit_close"), F.max("_d").alias("exit_date"))
        j = predictions.join(last, "symbol", "left")
        due = F.date_add("latest_date", F.col("horizon")) <= F.lit(asof).cast("date")
        ok = due & (F.col("exit_date") > F.col("latest_date"))
        j = j.withColumns({"exit_close": F.when(ok, F.col("exit_close")), "exit_date": F.when(ok, F.col("exit_date"))})
    ret = F.col("exit_close") / F.col("latest_close") - 1
    p = F.col("p_up")
    hit = F.when(ret.isNotNull(), ((p > 0.5) & (ret > 0)) | ((p < 0.5) & (ret < 0)))
    return j.withColumns({"actual_return": ret, "verified": ret.isNotNull(), "hit": hit})


def best_alignment(a: DataFrame, b: DataFrame, search: int = 5, tail: int = 60, columns: Sequence[str] = ("open", "high", "low", "close"),
                   tol: float = 1e-6) -> DataFrame:
    """Row shift per symbol that makes most of the last ``tail`` aligned rows equal; ties: more rows, then smaller shift.

    Only the candidate shifts 0 and end-alignment +-``search`` are joined, each row against at most 2 * search + 2 others.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    ra = a.withColumn("ia", F.row_number().over(w) - 1)
    rb = b.withColumn("ib", F.row_number().over(w) - 1)
    na, nb = ra.groupBy("symbol").agg(F.count(F.lit(1)).alias("na")), rb.groupBy("symbol").agg(F.count(F.lit(1)).alias("nb"))
    n = na.join(nb, "symbol")
    end = F.col("nb") - F.col("na")
    cand = n.withColumn("shift", F.explode(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), F.sequence(end - search, end + search)))))
    pairs = ra.join(cand, "symbol").withColumn("ib", F.col("ia") + F.col("shift"))
    rb2 = rb.select("symbol", "ib", *[F.col(c).alias(f"_b_{c}") for c in columns])
    m = pairs.join(rb2.withColumn("ib", F.col("ib").cast("long")), ["symbol", "ib"])
    eq = F.lit(True)
    for c in columns:
        eq = eq & (F.abs(F.col(c) - F.col(f"_b_{c}")) <= tol)
    hi = F.least(F.col("na"), F.col("nb") - F.col("shift"))
    g = m.groupBy("symbol", "shift").agg(
        F.sum(F.when((F.col("ia") >= hi - tail) & eq, 1).otherwise(0)).alias("tail_equal"), F.count(F.lit(1)).alias("rows"))
    key = F.struct("tail_equal", "rows", (-F.abs("shift")).alias("_s"), (-F.col("shift")).alias("_t"))
    return g.groupBy("symbol").agg(F.max_by(F.struct("shift", "tail_equal", "rows"), key).alias("_x")).select("symbol", "_x.*")


def reconcile(a: DataFrame, b: DataFrame, min_common: int = 30, tol: float = 1e-6, columns: Sequence[str] = ("open", "high", "low", "close")) -> DataFrame:
    """Snapshot comparison after alignment: equal rows, volume equality, date-label mismatch and a divergence verdict."""
    best = best_alignment(a, b, columns=columns, tol=tol)
    w = Window.partitionBy("symbol").orderBy("date")
    ra = a.withColumn("_i", F.row_number().over(w) - 1).join(best.select("symbol", "shift"), "symbol").withColumn("_j", F.col("_i") + F.col("shift"))
    rb = b.withColumn("_j", (F.row_number().over(w) - 1).cast("long")).select(
        "symbol", "_j", F.col("date").alias("_bd"), F.col("volume").alias("_bv"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    j = ra.join(rb, ["symbol", "_j"])
    eq = F.lit(True)
    for c in columns:
        eq = eq & (F.abs(F.col(c) - F.col(f"_b_{c}")) <= tol)
    j = j.withColumn("_eq", eq)
    last_bad = F.max(F.when(~F.col("_eq"), F.col("_i")))
    first_ok = F.min(F.when(F.col("_eq"), F.col("_i")))
    g = j.groupBy("symbol").agg(
        F.first("shift").alias("shift"), F.count(F.lit(1)).alias("aligned_rows"), F.sum(F.col("_eq").cast("int")).alias("equal_rows"),
        F.avg((F.abs(F.col("volume") - F.col("_bv")) <= tol).cast("double")).alias("volume_rate"),
        F.sum((F.col("_eq") & (F.col("date") != F.col("_bd"))).cast("int")).alias("label_mismatch"),
        last_bad.alias("_lb"), first_ok.alias("_fo"),
        F.stddev_pop(F.when(~F.col("_eq"), F.col("close") / F.col("_b_close"))).alias("_rs"))
    verdict = (F.when(F.col("aligned_rows") < min_common, "unverifiable").when(F.col("equal_rows") == F.col("aligned_rows"), "replayable")
               .when((F.col("_lb") < F.col("_fo")) & (F.col("_rs") < 1e-6), "rescaled_history").when(F.col("_lb") < F.col("_fo"), "old_part_differs")
               .otherwise("scattered"))
    return g.withColumn("verdict", verdict).drop("_lb", "_fo", "_rs")


def forecast_positions(actual: DataFrame, forecast: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Forecast rows after the last actual date turned into a held position (+1/-1, last non-zero signal carried)."""
    last = actual.groupBy("symbol").agg(F.max_by("close", "date").alias("_lc"), F.max("date").alias("_ld"))
    f = forecast.join(last, "symbol").filter(F.col("date") > F.col("_ld"))
    r = F.col("price") / F.col("_lc") - 1
    f = f.withColumn("signal", F.when(r > threshold, 1).when(r < -threshold, -1))
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return f.select("symbol", "date", "price", F.coalesce("signal", F.lit(0)).alias("signal"),
                    F.coalesce(F.last("signal", ignorenulls=True).over(w), F.lit(0)).alias("position"))
