"""Panel statistics: hit rates, neutral band, gates, quantile returns, trends, multiple testing, correlations."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import two_sided_p
from panelspark.operators.order_stats import positions, running, running_sum, spearman, value_ranks
from panelspark.operators.windows import Series, pearson

COST_TIERS = {"conservative": 0.00125, "base": 0.00075, "aggressive": 0.00030}  # fixed one-side costs


def hit_rate(score="score", ret="fwd_ret", band: float = 0.0) -> Column:
    """Share of equal signs; zero returns and |score| <= band are left out."""
    s, r = F.col(score), F.col(ret)
    live = (F.abs(s) > band) & (r != 0)
    return F.coalesce(F.avg(F.when(live, ((s > 0) == (r > 0)).cast("double"))), F.lit(0.0))


def gate_hit_rate(score="score", ret="fwd_ret") -> Column:
    """Ties stay in the denominator."""
    s, r = F.col(score), F.col(ret)
    return F.avg(F.when(r.isNotNull(), (((s > 0) & (r > 0)) | ((s < 0) & (r < 0))).cast("double")))


def neutral_band(train: DataFrame, keys: Sequence[str], score: str = "score", ret: str = "fwd_ret",
                 grid: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7), keep: float = 0.5, min_samples: int = 10) -> DataFrame:
    """Band (0 or a quantile-grid value of the distinct |score|) with the best hit rate of the samples above it, keeping
    at least ``keep`` of them; the smallest on ties, 0 for tiny inputs.  All grid rows come from one running sum."""
    d = train.filter(F.col(score).isNotNull() & F.col(ret).isNotNull() & (F.col(ret) != 0))
    ok = ((F.col(score) > 0) == (F.col(ret) > 0)).cast("long")
    g = d.groupBy(*keys, F.abs(score).alias("_a")).agg(F.count(F.lit(1)).alias("_n"), F.sum(ok).alias("_h"))
    zero = d.select(*keys).distinct().select(*keys, F.lit(0.0).alias("_a"), F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_h"))
    g = g.unionByName(zero).groupBy(*keys, "_a").agg(F.sum("_n").alias("_n"), F.sum("_h").alias("_h")).withColumn("_one", (F.col("_n") > 0).cast("long"))
    r = running_sum(g, keys, ["_a"], {"_cn": "_n", "_ch": "_h", "_pos": "_one"})
    tot = g.groupBy(*keys).agg(F.sum("_n").alias("_tn"), F.sum("_h").alias("_th"), F.sum("_one").alias("_m"))
    picks = F.array(*[F.least(F.floor(F.col("_m") * q) + 1, F.col("_m")) for q in grid])
    j = r.join(tot, list(keys)).filter((F.col("_a") == 0) | ((F.col("_one") == 1) & F.array_contains(picks, F.col("_pos"))))
    kept = F.col("_tn") - F.col("_cn")
    j = j.filter((kept >= F.greatest(F.floor(F.col("_tn") * keep), F.lit(1))) & (F.col("_tn") >= min_samples))
    j = j.select(*keys, F.col("_a").alias("band"), F.try_divide(F.col("_th") - F.col("_ch"), kept).alias("hit_rate"), kept.alias("kept"))
    best = j.groupBy(*keys).agg(F.max_by(F.struct("band", "hit_rate", "kept"), F.struct("hit_rate", -F.col("band"))).alias("_x"))
    none = F.lit(None)
    return tot.select(*keys).join(best, list(keys), "left").select(
        *keys, F.coalesce("_x.band", F.lit(0.0)).alias("band"), F.coalesce(F.col("_x.hit_rate"), none).alias("hit_rate"), F.col("_x.kept").alias("kept"))


def windowed_ic(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, x: str = "score", y: str = "fwd_ret") -> DataFrame:
    """IC of consecutive windows of ``size`` rows (whole windows only): (keys, win, n, ic)."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    p = positions(d, keys, order).withColumn("win", F.floor((F.col("pos") - 1) / size))
    ic = spearman(p, [*keys, "win"], x, y, bounded=True)  # windows hold ``size`` rows
    return ic.filter(F.col("n") == size)


def icir(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    g = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), F.avg("ic").alias("mean_ic"), F.stddev_pop("ic").alias("_sd"))
    return g.withColumn("icir", F.when(F.col("_sd") > 1e-6, F.col("mean_ic") / F.nullif("_sd", F.lit(0.0))).otherwise(0.0)).drop("_sd")


def horizon_gate(df: DataFrame, keys: Sequence[str], order: Sequence[str], window: int, min_samples: int = 30, min_ic: float = 0.02,
                 min_hit: float = 0.52, min_windows: int = 3) -> DataFrame:
    """Samples, IC, hit rate and windows against thresholds, with the failing criteria as text."""
    d = df.filter(F.col("score").isNotNull() & F.col("fwd_ret").isNotNull())
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), hit_rate().alias("hit_rate"))
    j = g.join(spearman(d, keys, "score", "fwd_ret").drop("n"), list(keys)).join(icir(windowed_ic(d, keys, order, window), keys), list(keys), "left")
    j = j.withColumn("windows", F.coalesce("windows", F.lit(0)))
    ok = F.col("samples") >= min_samples
    fails = F.array_compact(F.array(F.when(~ok, "samples"), F.when(F.abs("ic") < min_ic, "ic"), F.when(F.col("hit_rate") < min_hit, "hit_rate"),
                                    F.when(F.col("windows") < min_windows, "windows")))
    return j.withColumns({"passed": (F.size(fails) == 0).cast("int"), "reason": F.concat_ws(",", fails)})


def gate_shortfall(gate: DataFrame, keys: Sequence[str], targets: dict[str, float]) -> DataFrame:
    """Relative gap to each threshold and the binding metric (largest gap)."""
    arms = F.array(*[F.struct(F.lit(m).alias("metric"), F.abs(F.col(m)).cast("double").alias("value"), F.lit(float(t)).alias("target")) for m, t in targets.items()])
    x = gate.select(*keys, F.explode(arms).alias("_x")).select(*keys, "_x.*").withColumn("gap", F.greatest(F.lit(0.0), (F.col("target") - F.col("value")) / F.col("target")))
    w = Window.partitionBy(*keys).orderBy(F.desc("gap"), "metric")
    return x.withColumn("binding", ((F.row_number().over(w) == 1) & (F.col("gap") > 0)).cast("int"))


def fisher_interval(ic="ic", n="n", z: float = 1.959963984540054) -> Column:
    """struct(low, high) by the Fisher transform; null under 10 samples."""
    r, k = F.col(ic), F.col(n)
    edge, se = F.abs(r) >= 1, z / F.sqrt(F.greatest(k - 3, F.lit(1)))
    a = F.atanh(F.when(~edge, r))
    return F.when(k >= 10, F.struct(F.when(edge, r).otherwise(F.tanh(a - se)).alias("low"), F.when(edge, r).otherwise(F.tanh(a + se)).alias("high")))


def quantile_buckets(df: DataFrame, keys: Sequence[str], order: Sequence[str], n_quantiles: int = 5) -> DataFrame:
    """Equal-frequency bucket 1..Q from exact positions (boundaries q*n//Q)."""
    p = positions(df, keys, order)
    tot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else df.agg(F.count(F.lit(1)).alias("_n"))
    j = p.join(tot, list(keys)) if keys else p.join(F.broadcast(tot))
    b = F.lit(n_quantiles)
    for i in range(n_quantiles - 1, 0, -1):
        b = F.when(F.col("pos") - 1 < F.floor(F.col("_n") * i / n_quantiles), i).otherwise(b)
    return j.withColumn("quantile", b)


def quantile_returns(df: DataFrame, keys: Sequence[str], tie: Sequence[str], n_quantiles: int = 5, score: str = "score", ret: str = "fwd_ret") -> DataFrame:
    """Mean return and hit rate per score bucket."""
    d = df.filter(F.col(score).isNotNull() & F.col(ret).isNotNull())
    b = quantile_buckets(d, keys, [score, *tie], n_quantiles)
    return b.groupBy(*keys, "quantile").agg(F.count(F.lit(1)).alias("samples"), F.avg(ret).alias("mean_return"), hit_rate(score, ret).alias("hit_rate"))


def quantile_spread(qr: DataFrame, keys: Sequence[str], n_quantiles: int = 5) -> DataFrame:
    """Top minus bottom mean return and the rank correlation of bucket and mean return."""
    s = qr.groupBy(*keys).agg((F.max(F.when(F.col("quantile") == n_quantiles, F.col("mean_return"))) - F.max(F.when(F.col("quantile") == 1, F.col("mean_return")))).alias("spread"))
    return s.join(spearman(qr, keys, "quantile", "mean_return", "monotonic_ic", bounded=True).drop("n"), list(keys))


def turnover(df: DataFrame, keys: Sequence[str], order: Sequence[str], score: str = "score") -> DataFrame:
    """Share of sign flips between neighbours; a zero is no flip but stays in the denominator."""
    s = Series(keys=keys, order=order)
    d = df.filter(F.col(score).isNotNull()).withColumn("_p", s.lag(score))
    live = (F.abs(F.col("_p")) > 1e-12) & (F.abs(F.col(score)) > 1e-12)
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.sum(F.when(live & ((F.col("_p") > 0) != (F.col(score) > 0)), 1).otherwise(0)).alias("flips"))
    return g.withColumn("turnover", F.try_divide(F.col("flips"), F.col("samples") - 1))


def horizon_decay(bars_scores: DataFrame, days: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """IC of one score against the return of every holding period, all periods in one pass."""
    s = Series()
    df = bars_scores.withColumns({f"_f{h}": s.lead("close", h) / F.col("close") - 1 for h in days})
    long = df.select(*keys, "score", F.explode(F.array(*[F.struct(F.lit(h).alias("days"), F.col(f"_f{h}").alias("fwd_ret")) for h in days])).alias("_x")).select(
        *keys, "score", "_x.days", "_x.fwd_ret")
    return spearman(long, [*keys, "days"], "score", "fwd_ret")


def cost_sensitivity(spreads: DataFrame, days: Sequence[int], tiers: dict[str, float] = COST_TIERS) -> DataFrame:
    """net = spread - 2 * one-side cost * turnover * days for every tier and period."""
    t = F.explode(F.array(*[F.struct(F.lit(n).alias("tier"), F.lit(c).alias("one_side"), F.lit(d).alias("days")) for n, c in tiers.items() for d in days]))
    x = spreads.withColumn("_t", t).select("*", "_t.*").drop("_t")
    return x.withColumn("cost", 2 * F.col("one_side") * F.greatest(F.col("turnover") * F.col("days"), F.lit(0.0))).withColumn("net", F.col("spread") - F.col("cost"))


def ic_trend(df: DataFrame, keys: Sequence[str], order: Sequence[str], window: int, step: int, floor: float = 0.02) -> DataFrame:
    """IC on rolling anchors (window of rows ending at every ``step``-th row), its slope, r2, steps to the floor, status.

    A row is copied to the anchors whose window holds it: window / step copies, independent of group size.
    """
    d = positions(df.filter(F.col("score").isNotNull() & F.col("fwd_ret").isNotNull()), keys, order)
    tot = d.groupBy(*keys).agg(F.max("pos").alias("_n"))
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - window) / step))
    x = d.join(tot, list(keys)).withColumn("anchor", F.explode(F.sequence(first.cast("long"), F.floor((F.col("pos") - 1) / step).cast("long"))))
    x = x.filter(F.col("anchor") * step + window <= F.col("_n"))
    a = spearman(x, [*keys, "anchor"], "score", "fwd_ret", bounded=True)
    g = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("anchors"), F.max_by("ic", "anchor").alias("last_ic"), F.regr_slope("ic", "anchor").alias("slope"),
                             (pearson("ic", "anchor") * pearson("ic", "anchor")).alias("r2"))
    steps = F.when((F.col("slope") < 0) & (F.col("last_ic") > floor), (F.col("last_ic") - floor) / F.nullif(-F.col("slope"), F.lit(0.0)))
    return g.withColumns({"steps_to_floor": steps, "status": F.when(F.col("anchors") < 3, "insufficient").when(F.col("last_ic") <= floor, "breached")
                          .when((F.col("slope") < 0) & (F.col("r2") > 0.3), "declining").otherwise("stable")})


def ic_p_value(ic="ic", n="n") -> Column:
    """Two-sided normal approximation of an IC over n independent samples."""
    return two_sided_p(F.col(ic) * F.sqrt(F.greatest(F.col(n) - 1, F.lit(1))))


def multiple_testing(tests: DataFrame, p: str = "p", family: Sequence[str] = (), key: Sequence[str] = ("test",)) -> DataFrame:
    """Bonferroni and Holm step-down per family (a family holds one row per candidate)."""
    w = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(1))
    asc = w.orderBy(p, *key)
    d = tests.withColumns({"_m": F.count(F.lit(1)).over(w), "_k": F.row_number().over(asc)})
    d = d.withColumn("_s", F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_k") + 1)))
    return d.withColumns({"p_bonferroni": F.least(F.lit(1.0), F.col(p) * F.col("_m")),
                          "p_holm": F.max("_s").over(asc.rowsBetween(Window.unboundedPreceding, 0))}).drop("_m", "_k", "_s")


def partial_spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, z: str, h: int = 1) -> DataFrame:
    """Rank correlation of x and y with z held constant, its t with n / h effective samples, and an effect-size gate."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    ks = list(keys)
    a = spearman(d, ks, x, y, "rxy")
    j = a.join(spearman(d, ks, x, z, "rxz").drop("n"), ks).join(spearman(d, ks, y, z, "ryz").drop("n"), ks)
    den = F.sqrt((1 - F.col("rxz") * F.col("rxz")) * (1 - F.col("ryz") * F.col("ryz")))
    j = j.withColumn("partial_ic", F.when(den > 1e-12, (F.col("rxy") - F.col("rxz") * F.col("ryz")) / F.nullif(den, F.lit(0.0))))
    n_eff = F.floor(F.col("n") / h)
    pic = F.col("partial_ic")
    t = F.when((n_eff > 3) & (F.abs(pic) < 1), pic * F.sqrt(F.greatest(n_eff - 2, F.lit(0)) / F.nullif(1 - pic * pic, F.lit(0.0))))
    return j.withColumns({"n_eff": n_eff, "t": t}).withColumn("increment", ((F.abs("t") >= 2) & (F.abs("partial_ic") >= 0.1)).cast("int"))


def pair_correlations(returns: DataFrame, ret: str = "ret", min_periods: int = 60) -> DataFrame:
    """Pairwise-complete Pearson correlations (a < b) of a pool of up to a few thousand symbols.

    Dates are hashed over the tasks; each task keeps the pair sums of its own dates as matrices and emits every pair
    once, so the shuffle carries tasks x pairs rows instead of dates x pairs.
    """
    x = returns.filter(F.col(ret).isNotNull()).select("symbol", "date", F.col(ret).alias("r"))
    parts = int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if not rows:
            return
        wide = pd.concat(rows).pivot(index="date", columns="symbol", values="r")
        v, names = wide.to_numpy(), wide.columns.to_numpy()
        m = np.isfinite(v).astype(float)
        z = np.where(m > 0, v, 0.0)
        i, j = np.triu_indices(len(names), 1)
        n, sab, sa, qa = m.T @ m, z.T @ z, z.T @ m, (z * z).T @ m  # sa[i, j]: sum of i where j is present
        yield pd.DataFrame({"a": names[i], "b": names[j], "n": n[i, j], "xy": sab[i, j], "x": sa[i, j], "y": sa[j, i], "xx": qa[i, j], "yy": qa[j, i]})

    s = x.repartition(parts, "date").mapInPandas(sums, "a string, b string, n double, xy double, x double, y double, xx double, yy double")
    s = s.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n", "xy", *[F.when(F.col("a") < F.col("b"), F.col(p)).otherwise(F.col(o)).alias(p) for p, o in (("x", "y"), ("y", "x"), ("xx", "yy"), ("yy", "xx"))])
    g = s.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "xy", "x", "y", "xx", "yy")]).filter(F.col("n") >= min_periods)
    n, vx, vy = F.col("n"), F.col("xx") - F.col("x") * F.col("x") / F.col("n"), F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    rho = F.when((vx > 0) & (vy > 0), (F.col("xy") - F.col("x") * F.col("y") / n) / F.sqrt(F.when((vx > 0) & (vy > 0), vx * vy)))
    return g.select("a", "b", n.cast("long").alias("n"), rho.alias("rho"))


def participation(pairs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Effective dimension n^2 / sum(rho^2) of the correlation matrix, without an eigensolver."""
    n = symbols.agg(F.count_distinct("symbol").alias("n_symbols"))
    s = pairs.agg(F.sum(F.col("rho") * F.col("rho")).alias("_s"), F.avg("rho").alias("mean_rho"))
    return s.join(F.broadcast(n)).select("n_symbols", "mean_rho", (F.col("n_symbols") * F.col("n_symbols") / (F.col("n_symbols") + 2 * F.col("_s"))).alias("effective_dimension"))


def component_shares(complete: DataFrame, columns: Sequence[str], k: int = 3) -> DataFrame:
    """Explained-variance shares of the leading components on standardised complete rows."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    v = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(complete.dropna(subset=list(columns)))
    scaled = StandardScaler(inputCol="_v", outputCol="_x", withMean=True).fit(v).transform(v)
    ev = PCA(k=k, inputCol="_x", outputCol="_p").fit(scaled).explainedVariance.toArray().tolist()  # k numbers
    return complete.sparkSession.createDataFrame([(i + 1, float(x)) for i, x in enumerate(ev)], "component int, share double")


def auc(df: DataFrame, keys: Sequence[str], score: str = "p_up", label: str = "y") -> DataFrame:
    """Mann-Whitney AUC with average ranks."""
    d = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    c = d.groupBy(*keys, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_m"))
    r = value_ranks(c, keys, score, "_m").select(*keys, score, "rank")
    j = c.join(r, [*keys, score]).groupBy(*keys).agg(F.sum(F.col("_pos") * F.col("rank")).alias("_rs"), F.sum("_pos").alias("pos"), F.sum("_m").alias("n"))
    neg = F.col("n") - F.col("pos")
    return j.withColumn("auc", F.try_divide(F.col("_rs") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * neg)).drop("_rs")


def trading_metrics(df: DataFrame, keys: Sequence[str], order: Sequence[str], p: str = "p_up", y: str = "y", ret: str = "fwd_ret", horizon: int | str = 1, fee: float = 0.0) -> DataFrame:
    """Classification scores and the net result of going long above 0.5 and short otherwise.

    A row nets its signed return (null: 0) less ``fee`` on both sides.  The ratio of mean and population deviation is annualised by sqrt(252 / horizon)
    (a number, or a column that is constant within ``keys``); the drawdown is that of the running sum from its own peak; the profit factor is 999
    where nothing was lost, and then marked.
    """
    h_days = F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)
    d = df.filter(F.col(y).isNotNull()).withColumn("_hat", (F.col(p) > 0.5).cast("int")).withColumn("_ann", F.sqrt(252.0 / F.greatest(h_days, F.lit(1))))
    gross = F.coalesce(F.when(F.col("_hat") == 1, F.col(ret)).otherwise(-F.col(ret)), F.lit(0.0))
    d = d.withColumn("_net", gross - 2 * fee)
    peak = running(running_sum(d, keys, order, {"_cum": "_net"}), keys, order, maxes={"_peak": "_cum"})
    h, t, net = F.col("_hat"), F.col(y), F.col("_net")

    def n(c):
        return F.sum(c.cast("long"))

    g = peak.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((h == t).cast("double")).alias("accuracy"), n((h == 1) & (t == 1)).alias("_tp"), n(h == 1).alias("_pp"), n(t == 1).alias("_ap"),
        F.avg(net).alias("_m"), F.stddev_pop(net).alias("_s"), F.max("_ann").alias("_ann"), F.min(F.col("_cum") - F.col("_peak")).alias("max_drawdown"),
        F.sum(F.when(net > 0, net).otherwise(0.0)).alias("_win"), F.sum(F.when(net < 0, -net).otherwise(0.0)).alias("_loss"), F.sum(net).alias("total_return"), F.avg((net > 0).cast("double")).alias("win_rate"))
    pr, rc = F.coalesce(F.try_divide(F.col("_tp"), F.col("_pp")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("_tp"), F.col("_ap")), F.lit(0.0))
    return g.select(*keys, "n", "accuracy", pr.alias("precision"), rc.alias("recall"), F.coalesce(F.try_divide(2 * pr * rc, pr + rc), F.lit(0.0)).alias("f1"),
                    F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.col("_ann")).otherwise(0.0).alias("sharpe"), "max_drawdown",
                    F.when(F.col("_loss") > 0, F.col("_win") / F.col("_loss")).otherwise(999.0).alias("profit_factor"), (F.col("_loss") <= 0).alias("profit_factor_is_capped"),
                    "total_return", "win_rate")


def paired_t(df: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    """Mean paired difference, its t, and adopt / reject / defer."""
    g = df.filter(F.col(delta).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(delta).alias("mean_delta"), F.stddev_samp(delta).alias("_s"))
    t = F.try_divide(F.col("mean_delta") * F.sqrt("n"), F.col("_s"))
    return g.withColumn("t", t).drop("_s").withColumn("verdict", F.when((F.col("n") < 8) | F.col("t").isNull(), "defer").when(F.col("t") >= 2, "adopt").when(F.col("t") <= -2, "reject").otherwise("defer"))


def paired_vs_baseline(arms: DataFrame, baseline: str, period: Sequence[str], value: str = "ret") -> DataFrame:
    """Per-arm paired differences to the baseline arm on shared periods, with Holm-adjusted p values."""
    base = arms.filter(F.col("arm") == baseline).select(*period, F.col(value).alias("_b"))
    d = arms.filter(F.col("arm") != baseline).join(base, list(period)).withColumn("delta", F.col(value) - F.col("_b"))
    t = paired_t(d, ["arm"], "delta").withColumn("p", two_sided_p("t"))
    return multiple_testing(t, "p", key=("arm",))


def hit_rate_z(hit: Column, n: Column) -> Column:
    return (hit - 0.5) / F.sqrt(0.25 / n)


def increment_verdict(candidate: Column, base: Column, eps: float) -> Column:
    d = candidate - base
    return F.when(d.isNull(), "unavailable").when(d > eps, "improved").when(d < -eps, "degraded").otherwise("unchanged")


def evidence_weights(gate: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Horizon weights proportional to |IC| * max(hit - 0.5, 0); equal when nothing qualifies (one row per horizon)."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    d = gate.withColumn("_e", F.abs("ic") * F.greatest(F.col("hit_rate") - 0.5, F.lit(0.0)))
    return d.withColumn("weight", F.when(F.sum("_e").over(w) > 0, F.try_divide(F.col("_e"), F.sum("_e").over(w))).otherwise(1 / F.count(F.lit(1)).over(w))).drop("_e")


def weight_comparison(aligned: DataFrame, plans: dict[str, dict[str, float]], ret: str = "fwd_ret") -> DataFrame:
    """IC and hit rate of each candidate weighting of the aligned horizon scores."""
    arms = F.array(*[F.struct(F.lit(n).alias("plan"), sum((F.col(c) * w for c, w in ws.items()), F.lit(0.0)).alias("score")) for n, ws in plans.items()])
    x = aligned.select(ret, F.explode(arms).alias("_x")).select(F.col(ret).alias("fwd_ret"), "_x.plan", "_x.score")
    return spearman(x, ["plan"], "score", "fwd_ret").join(x.filter("fwd_ret is not null").groupBy("plan").agg(hit_rate().alias("hit_rate")), "plan")
