"""Model queries (ML*, XS4, RM12-RM14, RM16): rows-only, Spark ML fits are not SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import indicators as ti
from panelspark.operators import regimes
from panelspark.operators import labels as lb
from panelspark.operators import models as ml
from panelspark.operators import statistics as st
from panelspark.operators.windows import rnd
from panelspark.plans.labels import market
from panelspark.plans.registry import query
from panelspark.sources import derive

FEATURES = ["ma_5_ratio", "ma_20_ratio", "ret_1", "ret_5", "rsi", "volatility", "boll_pos", "volume_ratio"]


def panel(spark, sf, h=5):
    return lb.supervised(ti.base_features(derive.bars(spark, sf)), FEATURES, h)


@query("walk_forward_model", "ML1 ML2 RM12 RM14", None)
def walk_forward_model(spark, sf):
    s = ml.walk_forward_scores(panel(spark, sf), FEATURES, folds=2)
    return rnd(s.select("symbol", "date", "fold", "p_up", "target"), 6)


@query("model_metrics", "ML2 RM12 ST27 ST28", None)
def model_metrics(spark, sf):
    s = ml.walk_forward_scores(panel(spark, sf), FEATURES, folds=2, kind="logistic").withColumnsRenamed({"target": "y", "_fwd_ret": "fwd_ret"})
    m = st.trading_metrics(s, ["fold"], ["date", "symbol"])
    return rnd(m.join(st.auc(s, ["fold"]).select("fold", "auc"), "fold"))


@query("pool_models", "ML3 ML7 ML8", None)
def pool_models(spark, sf):
    """One model per pool, latest rows of all symbols scored, unknown pools routed to the pooled model."""
    n = F.right("symbol", F.lit(1)).cast("int")
    feats = ti.base_features(derive.bars(spark, sf)).withColumn("pool", F.when(n < 4, "a").when(n < 8, "b").otherwise("c"))
    p = panel(spark, sf).withColumn("pool", F.when(n < 4, "a").when(n < 8, "b").otherwise("c"))
    models = ml.train_pools(p, FEATURES, "pool", ["a", "b"])
    last = feats.groupBy("symbol").agg(F.max_by(F.struct("date", "pool", *FEATURES), "date").alias("z")).select("symbol", "z.*")
    return rnd(ml.score_pools(models, last, "pool").select("symbol", "date", "pool", "model", "p_up"))


@query("feature_model_ablation", "ML4 PRJ6", None)
def feature_model_ablation(spark, sf):
    arms = {"all_gbt": (FEATURES, "gbt"), "trend_logistic": (["ma_5_ratio", "ma_20_ratio"], "logistic"), "momentum_forest": (["ret_1", "ret_5", "rsi"], "forest")}
    return rnd(ml.arm_comparison(panel(spark, sf), arms, folds=2))


@query("label_comparison", "ML5 RM13", None)
def label_comparison(spark, sf):
    tb = lb.triple_barrier(ti.label_volatility(derive.bars(spark, sf))).select("symbol", "date", lb.to_binary("tb_label").alias("tb_binary"))
    return rnd(ml.label_comparison(panel(spark, sf).join(tb, ["symbol", "date"]), FEATURES, ["target", "tb_binary"], folds=2))


@query("horizon_scores", "ML7", None)
def horizon_scores(spark, sf):
    """Latest rows of all symbols under the models of three horizons, and their blend."""
    f = ti.base_features(derive.bars(spark, sf)).select("symbol", "date", *FEATURES)
    models = ml.train_horizons({h: panel(spark, sf, h) for h in (1, 5, 20)}, FEATURES, kind="logistic")
    last = f.groupBy("symbol").agg(F.max_by(F.struct("date", *FEATURES), "date").alias("z")).select("symbol", "z.*")
    return rnd(ml.score_horizons(models, last, {1: 0.2, 5: 0.5, 20: 0.3}).drop(*FEATURES))


@query("horizon_holdout", "RM14", None)
def horizon_holdout(spark, sf):
    s = ml.holdout_by_horizon({h: panel(spark, sf, h) for h in (1, 5, 20)}, FEATURES, folds=2, kind="logistic")
    return rnd(s.select("horizon", "symbol", "date", "fold", "p_up", "target"))


@query("factor_comparison", "ML5", None)
def factor_comparison(spark, sf):
    base = ["ma_5_ratio", "ma_20_ratio", "ret_1", "ret_5"]
    return rnd(ml.factor_comparison(panel(spark, sf), base, [c for c in FEATURES if c not in base], folds=2, kind="logistic"))


@query("parameter_search", "ML6", None)
def parameter_search(spark, sf):
    return rnd(ml.tune(panel(spark, sf), FEATURES, [{"kind": "gbt", "maxDepth": 2}, {"kind": "gbt", "maxDepth": 4}, {"kind": "logistic"}], folds=2))


@query("incremental_retrain", "RM16 ML7", None)
def incremental_retrain(spark, sf):
    p = panel(spark, sf)
    cut = F.lit("2000-01-01").cast("date")
    m = ml.retrain(FEATURES, p.filter(F.col("date") < cut), p.filter(F.col("date") >= cut))
    return rnd(ml.score_latest(m, ti.base_features(derive.bars(spark, sf)).select("symbol", "date", *FEATURES)).select("symbol", "date", "p_up"))


def market_observations(spark, sf):
    return lb.regime_observations(market(spark, sf).withColumn("pool", F.lit("all")), keys=("pool",), ret="market_ret").select("pool", "date", "log_ret", "vol")


@query("mixture_regimes", "XS4", None)
def mixture_regimes(spark, sf):
    """Labels of the market's states; refits every 20 dates from the 60th on."""
    return regimes.labels(market_observations(spark, sf)).select("date", "state", "regime")


@query("regime_ic", "AG8 XS4", None)
def regime_ic(spark, sf):
    """Rank correlation of the score inside each state."""
    from panelspark.operators.order_stats import spearman

    r = regimes.labels(market_observations(spark, sf)).select("date", "regime")
    s = derive.scores(derive.bars(spark, sf), horizons=(5,)).join(r, "date")
    return rnd(spearman(s, ["regime"], "p_up", "fwd_ret"))


