"""Grouped reports over scores, predictions, snapshots and attributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.order_stats import quantile_array, spearman


def ratio(n, d) -> Column:
    return F.try_divide(n, d)


def daily_sentiment(scored_news: DataFrame) -> DataFrame:
    """Per day: mean and deviation of sentiment (0 for one item), mean positive and negative share, count."""
    return scored_news.groupBy("date").agg(
        F.avg("sentiment").alias("sentiment_mean"), F.coalesce(F.stddev_samp("sentiment"), F.lit(0.0)).alias("sentiment_std"),
        F.avg("positive_score").alias("positive_mean"), F.avg("negative_score").alias("negative_mean"), F.count(F.lit(1)).alias("news_count"))


def market_series(returns: DataFrame, ret: str = "ret") -> DataFrame:
    """Equal-weight market: mean available return per date, compounded.  The window runs on one row per date."""
    g = returns.filter(F.col(ret).isNotNull()).groupBy("date").agg(F.avg(ret).alias("market_ret"), F.count(ret).alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("log_price", F.sum(F.log1p("market_ret")).over(w)).withColumn("market_price", F.exp("log_price"))


def audit_report(verified: DataFrame, asof: str, drift_gap: float = 0.1, days: int = 30) -> DataFrame:
    """Totals, per horizon and per symbol in one pass (grouping sets), with the recent rate and a drift flag."""
    v = verified.withColumns({"_v": F.col("verified").cast("int"), "_h": F.coalesce(F.col("hit").cast("int"), F.lit(0)),
                              "_recent": (F.datediff(F.lit(asof).cast("date"), "latest_date") <= days).cast("int")})
    g = v.groupingSets([[], [F.col("horizon")], [F.col("symbol")]], F.col("horizon"), F.col("symbol")).agg(
        F.count(F.lit(1)).alias("records"), F.sum("_v").alias("verified"), F.sum(F.col("_h") * F.col("_v")).alias("hits"),
        F.sum(F.col("_v") * F.col("_recent")).alias("recent"), F.sum(F.col("_h") * F.col("_v") * F.col("_recent")).alias("recent_hits"))
    rate, rr = ratio(F.col("hits"), F.col("verified")), ratio(F.col("recent_hits"), F.col("recent"))
    return g.withColumns({"hit_rate": rate, "recent_hit_rate": rr, "drift": F.coalesce((rate - rr) > drift_gap, F.lit(False)).cast("int")})


def confidence_bins(samples: DataFrame, edges: Sequence[float], keys: Sequence[str] = (), min_samples: int = 5) -> DataFrame:
    """Coverage, hit rate, mean and mean-absolute return per confidence bin (last bin closed); empty bins appear."""
    n = len(edges) - 1
    c = F.col("confidence")
    b = F.lit(None)
    for i in range(n - 1, -1, -1):
        hi = (c <= edges[i + 1]) if i == n - 1 else (c < edges[i + 1])
        b = F.when((c >= edges[i]) & hi, i).otherwise(b)
    ks = list(keys)
    g = samples.withColumn("bin", b).groupBy(*ks, "bin").agg(
        F.count(F.lit(1)).alias("samples"), F.avg(F.col("hit").cast("double")).alias("hit_rate"),
        F.avg("actual_return").alias("mean_return"), F.avg(F.abs("actual_return")).alias("mean_abs_return"))
    total = samples.groupBy(*ks).agg(F.count(F.lit(1)).alias("_n"))
    frame = total.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    j = frame.join(g, [*ks, "bin"], "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    ok = F.col("samples") >= max(min_samples, 2)
    return j.select(*ks, "bin", F.get(F.array(*[F.lit(float(e)) for e in edges]), F.col("bin")).alias("lo"), "samples", (F.col("samples") / F.col("_n")).alias("coverage"),
                    ok.alias("available"), *[F.when(ok, F.col(x)).alias(x) for x in ("hit_rate", "mean_return", "mean_abs_return")])


def threshold_scan(samples: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = (), min_samples: int = 5) -> DataFrame:
    """Subset statistics for confidence >= t.  One aggregate per threshold in a single pass, no row multiplication."""
    ks, c = list(keys), F.col("confidence")
    aggs = []
    for i, t in enumerate(thresholds):
        sel = c >= t
        aggs += [F.sum(sel.cast("int")).alias(f"_n{i}"), F.avg(F.when(sel, F.col("hit").cast("double"))).alias(f"_h{i}"),
                 F.avg(F.when(sel, F.col("actual_return"))).alias(f"_r{i}")]
    g = samples.groupBy(*ks).agg(F.count(F.lit(1)).alias("_n"), *aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_n{i}").alias("samples"), F.col(f"_h{i}").alias("h"), F.col(f"_r{i}").alias("r"))
                     for i, t in enumerate(thresholds)])
    x = g.select(*ks, "_n", F.explode(rows).alias("_x"))
    ok = F.col("_x.samples") >= max(min_samples, 2)
    return x.select(*ks, F.col("_x.threshold").alias("threshold"), F.col("_x.samples").alias("samples"), ratio(F.col("_x.samples"), F.col("_n")).alias("coverage"),
                    ok.alias("available"), F.when(ok, F.col("_x.h")).alias("hit_rate"), F.when(ok, F.col("_x.r")).alias("mean_return"))


def decision_verdict(samples: DataFrame, threshold: float, keys: Sequence[str] = (), baseline: float = 0.5, min_total: int = 30, min_subset: int = 5) -> DataFrame:
    """effective only if the high-confidence subset beats both the base hit rate and the overall mean return."""
    sel = F.col("confidence") >= threshold
    g = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"), F.sum(sel.cast("int")).alias("n_subset"), F.avg(F.when(sel, F.col("hit").cast("double"))).alias("subset_hit_rate"),
        F.avg(F.when(sel, F.col("actual_return"))).alias("subset_mean_return"), F.avg("actual_return").alias("baseline_mean_return"))
    status = (F.when((F.col("n_total") < min_total) | (F.col("n_subset") < min_subset), "insufficient")
              .when((F.col("subset_hit_rate") > baseline) & (F.col("subset_mean_return") > F.col("baseline_mean_return")), "effective").otherwise("ineffective"))
    return g.withColumn("status", status)


def stratified(scores: DataFrame, state: str, keys: Sequence[str] = (), min_samples: int = 30) -> DataFrame:
    """IC, hit rate and accuracy per state; null under ``min_samples``."""
    ks = [*keys, state]
    s, r = F.col("score"), F.col("fwd_ret")
    live = (r != 0) & (s != 0)
    g = scores.filter(r.isNotNull()).groupBy(*ks).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(F.when(live, (F.signum(s) == F.signum(r)).cast("double"))).alias("hit_rate"),
        F.avg(((s > 0) == (r > 0)).cast("double")).alias("accuracy"))
    ic = spearman(scores, ks, "score", "fwd_ret").drop("n")
    j = g.join(ic, ks, "left")
    ok = F.col("samples") >= min_samples
    return j.select(*ks, "samples", *[F.when(ok, F.col(c)).alias(c) for c in ("ic", "hit_rate", "accuracy")])


def volatility_bands(scores: DataFrame, min_confidence: float, keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Volatility terciles inside the high-confidence subset with hit rate and mean return."""
    sub = scores.filter((F.col("confidence") >= min_confidence) & F.col("vol").isNotNull() & F.col("actual_return").isNotNull())
    cuts = quantile_array(sub, keys, "vol", [1 / 3, 2 / 3])
    j = sub.join(cuts, list(keys))
    band = F.when(F.col("vol") <= F.get("cuts", F.lit(0)), "low").when(F.col("vol") <= F.get("cuts", F.lit(1)), "mid").otherwise("high")
    return j.withColumn("band", band).groupBy(*keys, "band").agg(
        F.count(F.lit(1)).alias("samples"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("actual_return").alias("mean_return"))


def performance_history(perf: DataFrame, asof: str, days: int = 30) -> DataFrame:
    """Count, average, minimum and maximum accuracy per horizon over the last ``days``."""
    return perf.filter(F.col("date") > F.date_sub(F.lit(asof).cast("date"), days)).groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg("accuracy").alias("avg_accuracy"), F.min("accuracy").alias("min_accuracy"), F.max("accuracy").alias("max_accuracy"))


def accuracy_drift(perf: DataFrame, asof: str, days: int = 30, recent: int = 3, gap: float = 0.05) -> DataFrame:
    """Mean of the last ``recent`` accuracies against the earlier ones inside the period (one row per day and horizon)."""
    w = Window.partitionBy("horizon").orderBy(F.desc("date"))
    p = perf.filter(F.col("date") > F.date_sub(F.lit(asof).cast("date"), days)).withColumn("_k", F.row_number().over(w))
    g = p.groupBy("horizon").agg(F.avg(F.when(F.col("_k") <= recent, F.col("accuracy"))).alias("recent"),
                                 F.avg(F.when(F.col("_k") > recent, F.col("accuracy"))).alias("earlier"))
    return g.withColumn("drift", F.coalesce(F.abs(F.col("recent") - F.col("earlier")) > gap, F.lit(False)).cast("int"))


def trial_counts(trials: DataFrame, asof: str) -> DataFrame:
    """Trials up to ``asof`` by command with the total, and the number of distinct fingerprints."""
    t = trials.filter(F.col("date") <= F.lit(asof).cast("date"))
    return t.rollup("command").agg(F.count(F.lit(1)).alias("trials"), F.count_distinct("fingerprint").alias("distinct_trials"))


def stream_status(snapshots: DataFrame, asof: str, approximate: bool = False) -> DataFrame:
    n = (F.approx_count_distinct if approximate else F.count_distinct)("symbol")
    g = snapshots.agg(n.alias("symbols"), F.count(F.lit(1)).alias("snapshots"), F.max("ts").alias("last_ts"))
    return g.withColumn("age_seconds", F.unix_timestamp(F.lit(asof).cast("timestamp")) - F.unix_timestamp("last_ts"))


def importance(contrib: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature and its share."""
    g = contrib.groupBy("feature").agg(F.avg(F.abs("contrib")).alias("importance"))
    return g.withColumn("share", F.col("importance") / F.sum("importance").over(Window.partitionBy(F.lit(1))))  # one row per feature


def importance_drift(contrib: DataFrame, cut: str, top: int = 5) -> DataFrame:
    """Feature ranks before and from ``cut``, their shift, and the ``top`` largest shifts flagged."""
    late = F.col("date") >= F.lit(cut).cast("date")
    g = contrib.groupBy("feature").agg(F.avg(F.when(~late, F.abs("contrib"))).alias("early"), F.avg(F.when(late, F.abs("contrib"))).alias("late"))
    one = Window.partitionBy(F.lit(1))  # one row per feature
    g = g.withColumns({"early_rank": F.row_number().over(one.orderBy(F.desc("early"), "feature")), "late_rank": F.row_number().over(one.orderBy(F.desc("late"), "feature"))})
    g = g.withColumn("shift", F.col("early_rank") - F.col("late_rank"))
    return g.withColumn("top", (F.row_number().over(one.orderBy(F.desc(F.abs("shift")), "feature")) <= top).cast("int"))


def importance_by_state(contrib: DataFrame, top: int = 3) -> DataFrame:
    g = contrib.groupBy("state", "feature").agg(F.avg(F.abs("contrib")).alias("importance"))
    w = Window.partitionBy("state").orderBy(F.desc("importance"), "feature")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def direction_consistency(directions: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """consistent / partial / conflict by the set of directions a key shows."""
    s = F.array_sort(F.collect_set("direction"))  # at most three values
    g = directions.groupBy(*keys).agg(s.alias("_d"), F.count(F.lit(1)).alias("n"))
    st = (F.when(F.array_contains("_d", "up") & F.array_contains("_d", "down"), "conflict").when(F.size("_d") == 1, "consistent").otherwise("partial"))
    return g.select(*keys, "n", F.concat_ws(",", "_d").alias("directions"), st.alias("status"))


def series_health(series: DataFrame, expected: DataFrame, asof: str, stale_days: int = 120) -> DataFrame:
    """Count, last date and status per expected indicator."""
    g = series.groupBy("indicator").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last_date"))
    j = expected.join(g, "indicator", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    age = F.datediff(F.lit(asof).cast("date"), "last_date")
    return j.withColumn("status", F.when(F.col("n") == 0, "missing").when(age > stale_days, "stale").otherwise("ok"))
