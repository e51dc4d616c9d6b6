"""Probability calibration and conformal prediction."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.aggregates import threshold_scan
from panelspark.operators.order_stats import quantile_array, quantiles
from panelspark.session import ship


def reliability(df: DataFrame, keys: Sequence[str], p: str = "p_up", y: str = "y", bins: int = 10, min_samples: int = 0) -> DataFrame:
    """(keys, bin, n, mean_p, observed, gap): equal-width bins, the last one closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    g = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("observed"))
    return g.withColumns({"gap": F.abs(F.col("mean_p") - F.col("observed")), "available": (F.col("n") >= min_samples).cast("int")})


def calibration_errors(df: DataFrame, keys: Sequence[str], p: str = "p_up", y: str = "y", bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error."""
    d = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    brier = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))
    ece = reliability(d, keys, p, y, bins).groupBy(*keys).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
    return brier.join(ece, list(keys)) if keys else brier.join(F.broadcast(ece))


def logit(p) -> Column:
    c = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p) if isinstance(p, str) else p))
    return F.log(c / (1 - c))


def apply_platt(p: str, slope: float, intercept: float) -> Column:
    return F.when(F.col(p).isNotNull(), 1 / (1 + F.exp(-(logit(p) * slope + intercept))))


def apply_piecewise(p: str, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Linear interpolation through stored thresholds, flat outside."""
    x, n = F.col(p), len(xs)
    ax, ay = F.array(*[F.lit(float(v)) for v in xs]), F.array(*[F.lit(float(v)) for v in ys])
    i = F.size(F.filter(ax, lambda t: t <= x))
    x0, x1, y0, y1 = (F.get(a, F.greatest(F.lit(0), F.least(F.lit(n - 1), i - 1 + k))) for a, k in ((ax, 0), (ax, 1), (ay, 0), (ay, 1)))
    mid = y0 + (y1 - y0) * F.coalesce(F.try_divide(x - x0, x1 - x0), F.lit(0.0))
    return F.when(x.isNull(), None).when(i <= 0, F.get(ay, F.lit(0))).when(i >= n, F.get(ay, F.lit(n - 1))).otherwise(mid)


def conformal_quantiles(cal: DataFrame, keys: Sequence[str], alphas: Sequence[float], residual: str = "resid") -> DataFrame:
    """(keys, alpha, n, q): the ceil((n + 1)(1 - alpha)) / n quantile of the residuals, null where out of reach.

    Levels depend on n, so the exact order statistics are looked up at per-group levels.
    """
    n = cal.filter(F.col(residual).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    lv = n.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    lv = lv.withColumn("level", F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * (1 - F.col("alpha"))) / F.col("n")))
    q = _levels(cal, keys, residual, lv)
    return lv.join(q, [*keys, "alpha"], "left").withColumn("q", F.when(F.col("level") < 1, F.col("q"))).drop("level")


def _levels(cal: DataFrame, keys: Sequence[str], residual: str, lv: DataFrame) -> DataFrame:
    """Interpolated quantiles at the group's own levels through exact running counts."""
    from panelspark.operators.order_stats import value_ranks

    r = value_ranks(cal.filter(F.col(residual).isNotNull()), keys, residual).drop("rank")
    j = r.join(lv.filter(F.col("level") < 1).select(*keys, "alpha", ((F.col("n") - 1) * F.col("level")).alias("_h")), list(keys))
    lo, hi = F.floor("_h"), F.ceil("_h")
    a = F.max(F.when((lo >= F.col("cum") - F.col("n")) & (lo < F.col("cum")), F.col(residual)))
    z = F.max(F.when((hi >= F.col("cum") - F.col("n")) & (hi < F.col("cum")), F.col(residual)))
    g = j.groupBy(*keys, "alpha").agg(a.alias("_a"), z.alias("_z"), F.first("_h").alias("_h"))
    return g.select(*keys, "alpha", (F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_h") - F.floor("_h"))).alias("q"))


def coverage(intervals: DataFrame, keys: Sequence[str], y: str = "y", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Empirical coverage and mean width."""
    ok = ((F.col(y) >= F.col(lo)) & (F.col(y) <= F.col(hi))).cast("double")
    return intervals.filter(F.col(lo).isNotNull() & F.col(hi).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(ok).alias("coverage"), F.avg(F.col(hi) - F.col(lo)).alias("mean_width"))


def prediction_sets(df: DataFrame, q: DataFrame, keys: Sequence[str], p: str = "p_up") -> DataFrame:
    """Label sets {score 1 - p_y <= q}, their interval and confidence (both or none 0, single 0.5)."""
    j = df.join(q, list(keys))
    h0, h1 = F.col(p) <= F.col("q"), (1 - F.col(p)) <= F.col("q")
    j = j.withColumns({"has0": h0.cast("int"), "has1": h1.cast("int")})
    only1, only0 = (F.col("has1") == 1) & (F.col("has0") == 0), (F.col("has0") == 1) & (F.col("has1") == 0)
    j = j.withColumns({"set_lo": F.when(only1, 0.5).otherwise(0.0), "set_hi": F.when(only0, 0.5).otherwise(1.0)})
    return j.withColumn("set_confidence", 1 - (F.col("set_hi") - F.col("set_lo")))


def coverage_bootstrap(covered: DataFrame, keys: Sequence[str], flag: str = "covered", draws: int = 200, seed: int = 11) -> DataFrame:
    """Coverage with the 95 % percentile interval of ``draws`` resamples of a group's rows.

    Of n rows drawn with replacement from n, the covered ones are binomial, so a resample needs the group's two counts and no row.  Draws are
    seeded by group and number: reruns agree.
    """
    ship(covered.sparkSession)
    g = covered.filter(F.col(flag).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(flag).cast("double")).alias("coverage"))
    d = g.withColumn("_seed", F.xxhash64(F.lit(seed), *keys)).repartition(*keys) if keys else g.withColumn("_seed", F.lit(seed).cast("long"))

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            share = [np.random.default_rng(int(s) & (1 << 63) - 1).binomial(n, c, draws) / n for s, n, c in zip(b["_seed"], b["n"], b["coverage"], strict=True)]
            ends = np.percentile(np.array(share).reshape(-1, draws), [2.5, 97.5], axis=1) if len(b) else np.zeros((2, 0))
            yield b.drop(columns="_seed").assign(ci_low=ends[0], ci_high=ends[1])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "_seed"]
    return d.where("n > 0").mapInPandas(resample, ", ".join([*fields, "ci_low double", "ci_high double"]))


def width_bins(df: DataFrame, keys: Sequence[str], bins: int = 5, width: str = "width", error: str = "error") -> DataFrame:
    """Width bins by quantile edges with the 90 % error and the share of errors beyond the width."""
    cuts = quantile_array(df, keys, width, [i / bins for i in range(1, bins)])
    j = df.join(cuts, list(keys)).withColumn("bin", F.size(F.filter("cuts", lambda e: e < F.col(width))))
    g = j.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(width).alias("mean_width"), F.avg((F.col(error) > F.col(width)).cast("double")).alias("violation"))
    e = quantiles(j, [*keys, "bin"], error, [0.9]).select(*keys, "bin", F.col("q").alias("error_90"))
    return g.join(e, [*keys, "bin"])


def compare_confidences(samples: DataFrame, a: str, b: str, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Threshold curves of two confidence sources side by side."""
    x = threshold_scan(samples.withColumn("confidence", F.col(a)), thresholds, keys)
    z = threshold_scan(samples.withColumn("confidence", F.col(b)), thresholds, keys)
    on = [*keys, "threshold"]
    pick = ("samples", "hit_rate")
    return x.select(*on, *[F.col(c).alias(f"{c}_a") for c in pick]).join(z.select(*on, *[F.col(c).alias(f"{c}_b") for c in pick]), on)


def monotone_segments(samples: DataFrame, segment: str, thresholds: Sequence[float], tolerance: float = 0.005) -> DataFrame:
    """Per segment: whether the hit rate never falls by more than the tolerance along the thresholds."""
    c = threshold_scan(samples, thresholds, [segment])
    w = Window.partitionBy(segment).orderBy("threshold")
    c = c.filter(F.col("available")).withColumn("_ok", (F.col("hit_rate") >= F.coalesce(F.lag("hit_rate").over(w), F.col("hit_rate")) - tolerance).cast("int"))
    return c.groupBy(segment).agg(F.count(F.lit(1)).alias("points"), F.min("_ok").alias("monotone"))


def stability(segments: DataFrame, flag: str = "monotone") -> DataFrame:
    """Share of segments that hold and whether all do."""
    return segments.agg(F.count(F.lit(1)).alias("segments"), F.avg(F.col(flag).cast("double")).alias("stable_share"), F.every(F.col(flag) == 1).cast("int").alias("all_stable"))


def threshold_gate(curve: DataFrame, keys: Sequence[str], lo: float, hi: float, min_hit: float = 0.52, min_coverage: float = 0.05, min_n: int = 50) -> DataFrame:
    """Rows of the curve inside [lo, hi] that pass hit rate, coverage and size; the lowest passing threshold per key."""
    ok = (F.col("hit_rate") >= min_hit) & (F.col("coverage") >= min_coverage) & (F.col("samples") >= min_n) & F.col("threshold").between(lo, hi)
    return curve.groupBy(*keys).agg(F.sum(F.coalesce(ok, F.lit(False)).cast("int")).alias("passing"), F.min(F.when(ok, F.col("threshold"))).alias("recommended"))
