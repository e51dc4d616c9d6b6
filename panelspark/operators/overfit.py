"""Distribution drift, Sharpe-ratio inference and backtest-overfitting probabilities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import normal_cdf, normal_ppf
from panelspark.operators.order_stats import positions, quantile_array, running_sum
from panelspark.operators.windows import by_series
from panelspark.session import cut_lineage

EULER = 0.5772156649015329


def psi(df: DataFrame, keys: Sequence[str], side: str = "side", value: str = "value", bins: int = 10, eps: float = 1e-6, min_samples: int = 30) -> DataFrame:
    """Population stability index between ``side`` = 'ref' and 'cur' over quantile bins of the reference."""
    d = df.filter(F.col(value).isNotNull())
    cuts = quantile_array(d.filter(F.col(side) == "ref"), keys, value, [i / bins for i in range(1, bins)])
    b = d.join(cuts, list(keys)).withColumn("bin", F.size(F.filter("cuts", lambda e: e <= F.col(value))))
    ref = (F.col(side) == "ref").cast("int")
    c = b.groupBy(*keys, "bin").agg(F.sum(ref).alias("_r"), F.sum(1 - ref).alias("_c"))
    tot = c.groupBy(*keys).agg(F.sum("_r").alias("n_ref"), F.sum("_c").alias("n_cur"))
    grid = tot.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(c, [*keys, "bin"], "left")
    pr, pc = (F.greatest(F.coalesce(F.try_divide(F.col(x), F.col(n)), F.lit(0.0)), F.lit(eps)) for x, n in (("_r", "n_ref"), ("_c", "n_cur")))
    g = grid.groupBy(*keys).agg(F.first("n_ref").alias("n_ref"), F.first("n_cur").alias("n_cur"), F.sum((pc - pr) * F.log(pc / pr)).alias("psi"))
    return g.withColumn("psi", F.when((F.col("n_ref") >= min_samples) & (F.col("n_cur") >= min_samples), F.col("psi")))


def ks(df: DataFrame, keys: Sequence[str], side: str = "side", value: str = "value", min_samples: int = 30) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance from running counts over the distinct values."""
    r = (F.col(side) == "ref").cast("long")
    d = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(r).alias("_r"), F.sum(1 - r).alias("_c"))
    run = running_sum(d, keys, [value], {"_cr": "_r", "_cc": "_c"})
    tot = d.groupBy(*keys).agg(F.sum("_r").alias("_nr"), F.sum("_c").alias("_nc"))
    j = run.join(tot, list(keys))
    gap = F.max(F.abs(F.try_divide(F.col("_cr"), F.col("_nr")) - F.try_divide(F.col("_cc"), F.col("_nc"))))
    ok = (F.first("_nr") >= min_samples) & (F.first("_nc") >= min_samples)
    return j.groupBy(*keys).agg(F.when(ok, gap).alias("ks"))


def drift_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """PSI, KS and a verdict per feature."""
    j = psi(df, keys).join(ks(df, keys), list(keys), "left")
    v = (F.when(F.col("psi").isNull() | F.col("ks").isNull(), "unavailable").when((F.col("psi") > 0.25) | (F.col("ks") > 0.25), "significant_drift")
         .when(F.col("psi") > 0.1, "moderate_drift").otherwise("stable"))
    return j.withColumn("verdict", v)


def rolling_psi(df: DataFrame, keys: Sequence[str], order: Sequence[str], window: int, value: str = "value", bins: int = 10) -> DataFrame:
    """PSI of every later window of ``window`` rows against the first one."""
    p = positions(df.filter(F.col(value).isNotNull()), keys, order).withColumn("win", F.floor((F.col("pos") - 1) / window))
    full = p.groupBy(*keys, "win").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == window).drop("_n")
    p = p.join(full, [*keys, "win"], "left_semi")
    wins = p.select(*keys, "win").distinct().filter(F.col("win") > 0)
    ref = p.filter(F.col("win") == 0).drop("win").join(wins, list(keys)).withColumn("side", F.lit("ref"))
    cur = p.filter(F.col("win") > 0).withColumn("side", F.lit("cur"))
    return psi(ref.select(*keys, "win", "side", value).unionByName(cur.select(*keys, "win", "side", value)), [*keys, "win"], "side", value, bins).select(*keys, "win", "psi")


def moments(returns: DataFrame, keys: Sequence[str], ret: str = "ret", min_samples: int = 30) -> DataFrame:
    """n, Sharpe ratio per period, skewness and (plain) kurtosis with ddof-1 deviation, from central moments."""
    d = returns.filter(F.col(ret).isNotNull())
    m = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(ret).alias("_m"), F.stddev_samp(ret).alias("_s"))
    c = F.col(ret) - F.col("_m")
    g = d.join(m, list(keys)).groupBy(*keys).agg(F.first("n").alias("n"), F.first("_m").alias("_m"), F.first("_s").alias("_s"), F.avg(c * c * c).alias("_m3"), F.avg(c * c * c * c).alias("_m4"))
    s = F.when((F.col("n") >= min_samples) & (F.col("_s") > 1e-12), F.col("_s"))
    return g.select(*keys, "n", (F.col("_m") / s).alias("sr"), (F.col("_m3") / (s * s * s)).alias("skew"), (F.col("_m4") / (s * s * s * s)).alias("kurt"))


def sharpe_inference(returns: DataFrame, keys: Sequence[str], n_trials: int, ret: str = "ret", target: float = 0.95) -> DataFrame:
    """Probabilistic and deflated Sharpe ratio, and the minimum track record length."""
    m = moments(returns, keys, ret)
    sr, den = F.col("sr"), 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")
    m = m.withColumn("_den", F.when(den > 0, den))
    v = F.sqrt(F.col("_den") / (F.col("n") - 1))
    lift = (1 - EULER) * normal_ppf(F.lit(1 - 1 / n_trials)) + EULER * normal_ppf(F.lit(1 - 1 / (n_trials * math.e))) if n_trials > 1 else F.lit(0.0)
    m = m.withColumns({"expected_max_sr": v * lift, "_scale": F.sqrt(F.col("n") - 1) / F.sqrt("_den")})
    m = m.withColumns({"_z0": sr * F.col("_scale"), "_z1": (sr - F.col("expected_max_sr")) * F.col("_scale")})
    trl = F.ceil(1 + F.col("_den") * F.pow(normal_ppf(F.lit(target)) / F.when(sr > 0, sr), 2))
    return m.withColumns({"psr": normal_cdf("_z0"), "dsr": normal_cdf("_z1"), "min_track_length": trl}).drop("_den", "_scale", "_z0", "_z1")


def pbo_cscv(returns: DataFrame, trial: str, order: str, ret: str = "ret", n_blocks: int = 16, min_block: int = 15, min_dates: int = 30) -> DataFrame:
    """Probability of backtest overfitting: blocks of equal date count are summed once (n, sum, sum of squares); every
    half-and-half split is a bit mask joined to those block sums.  The split table has C(n_blocks, n_blocks / 2) rows.

    There are at most dates / ``min_block`` blocks, an even number; the dates left over at the end belong to none.  The champion is the trial with the
    best ratio of mean and deviation in sample (a constant trial has ratio 0, ties go to the first name); a split is overfit if the champion beats less than half
    of the other trials out of sample.  Under ``min_dates`` dates, two blocks or two trials there is no result row.
    """
    returns = returns.filter(F.col(ret).isNotNull())
    days = cut_lineage(returns.select(order).distinct().withColumn("_d", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order)) - 1))  # one row a date
    total, trials = days.count(), returns.select(trial).distinct().count()
    blocks = min(n_blocks, total // min_block) // 2 * 2
    if total < min_dates or blocks < 2 or trials < 2:
        return returns.sparkSession.createDataFrame([], "splits long, pbo double, mean_logit double")
    days = days.withColumn("block", F.floor(F.col("_d") / (total // blocks)).cast("int")).filter(F.col("block") < blocks)
    b = returns.join(days.select(order, "block"), order).groupBy(trial, "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum(ret).alias("s"), F.sum(F.col(ret) * F.col(ret)).alias("q"))
    sums = b.groupBy(trial).agg(F.collect_list(F.struct("block", "n", "s", "q")).alias("_b"))  # one struct a block
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << blocks) - 1)), lambda m: F.bit_count(m) == blocks // 2)
    j = by_series(sums.withColumn("mask", F.explode(masks)), ("mask",))

    def part(inside: int):
        sel = F.filter("_b", lambda x: F.getbit(F.col("mask"), x["block"]) == inside)

        def tot(f):
            return F.aggregate(sel, F.lit(0.0), lambda a, x: a + x[f])

        mean = F.try_divide(tot("s"), tot("n"))
        dev = F.sqrt(F.greatest(F.try_divide(tot("q"), tot("n")) - mean * mean, F.lit(0.0)))
        return F.coalesce(F.when(dev > 1e-12, F.try_divide(mean, dev)), F.lit(0.0))

    x = j.select("mask", trial, part(1).alias("is_sr"), part(0).alias("oos_sr"))
    x = x.withColumn("_r", F.rank().over(Window.partitionBy("mask").orderBy("oos_sr")))
    best = x.groupBy("mask").agg(F.min_by("_r", F.struct(-F.col("is_sr"), F.col(trial))).alias("_r"))
    beaten, w = (F.col("_r") - 1) / (trials - 1), F.col("_r") / (trials + 1)
    return best.agg(F.count(F.lit(1)).alias("splits"), F.avg((beaten < 0.5).cast("double")).alias("pbo"), F.avg(F.log(w / (1 - w))).alias("mean_logit"))


def pbo_paths(scores: DataFrame, path: str = "path", trial: str = "trial", is_score: str = "is_score", oos_score: str = "oos_score") -> DataFrame:
    """Share of paths whose in-sample champion ranks below the out-of-sample median."""
    med = scores.groupBy(path).agg(F.median(oos_score).alias("_med"), F.max_by(oos_score, F.struct(is_score, trial)).alias("_champ"))
    return med.agg(F.count(F.lit(1)).alias("paths"), F.avg((F.col("_champ") < F.col("_med")).cast("double")).alias("pbo"))


def deflated_shrinkage(trial_scores: DataFrame, score: str = "score") -> DataFrame:
    """Best score minus sqrt(2 ln N) standard deviations of the trial scores."""
    g = trial_scores.agg(F.count(score).alias("n_trials"), F.max(score).alias("best"), F.stddev_samp(score).alias("_s"))
    pen = F.sqrt(2 * F.log(F.greatest(F.col("n_trials"), F.lit(1)).cast("double"))) * F.coalesce("_s", F.lit(0.0))
    return g.select("n_trials", "best", pen.alias("penalty"), (F.col("best") - pen).alias("deflated"))


def trial_budget(trials: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Distinct trials per command and the Bonferroni level they leave."""
    g = trials.groupBy("command").agg(F.count_distinct("fingerprint").alias("distinct_trials"))
    return g.withColumn("alpha_left", F.lit(alpha) / F.col("distinct_trials"))
