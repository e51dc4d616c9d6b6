"""Model step on Spark ML: walk-forward scoring, pools, ablations, tuning, batch scoring.

Driver loops run over folds, arms or pools (at most dozens); the rows stay distributed and every fit is a Spark job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.order_stats import spearman
from panelspark.operators.splits import date_offsets, walk_forward
from panelspark.session import cut_lineage


def classifier(kind: str = "gbt", label: str = "target", **params):
    """Unfitted classifier by family: gbt, forest or logistic."""
    base = {"featuresCol": "_x", "labelCol": label}
    if kind == "gbt":
        return GBTClassifier(**base, **{"maxIter": 5, "maxDepth": 3, "seed": 7, **params})
    if kind == "forest":
        return RandomForestClassifier(**base, **{"numTrees": 20, "maxDepth": 5, "seed": 7, **params})
    if kind == "logistic":
        return LogisticRegression(**base, **{"maxIter": 20, "regParam": 0.01, **params})
    raise ValueError(f"unknown model family {kind}")


def train(df: DataFrame, features: Sequence[str], label: str = "target", kind: str = "gbt", validation: str | None = None, **params) -> PipelineModel:
    """Standardise + classifier; ``validation`` names a boolean column for early stopping of the boosted trees."""
    clf = classifier(kind, label, **params)
    if validation and kind == "gbt":
        clf = clf.setValidationIndicatorCol(validation)
    stages = [VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip"), StandardScaler(inputCol="_v", outputCol="_x", withMean=True), clf]
    return Pipeline(stages=stages).fit(df.filter(F.col(label).isNotNull()))


def score(model: PipelineModel, df: DataFrame, out: str = "p_up") -> DataFrame:
    """Every row of ``df``; the score is null where a feature is null or NaN."""
    assembler = model.stages[0]
    assembler.setHandleInvalid("keep")
    whole = reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in assembler.getInputCols()])
    return model.transform(df).withColumn(out, F.when(whole, vector_to_array("probability")[1])).drop("_v", "_x", "rawPrediction", "probability", "prediction")


def walk_forward_scores(panel: DataFrame, features: Sequence[str], label: str = "target", folds: int = 3, purge: int = 5, kind: str = "gbt", **params) -> DataFrame:
    """Out-of-sample probabilities: one fit per fold on the rows before it (minus the purge), union of the test rows."""
    out = None
    assigned = cut_lineage(walk_forward(panel, folds, purge))  # every fold reads the checkpoint, not the feature plan
    for f in sorted(r[0] for r in assigned.filter(F.col("fold").isNotNull()).select("fold").distinct().collect()):  # short panels have fewer folds than asked for
        part = assigned.filter(F.col("fold") == f)
        m = train(part.filter(F.col("role") == "train"), features, label, kind, **params)
        s = score(m, part.filter(F.col("role") == "test")).drop("total", "pos", "role")
        out = s if out is None else out.unionByName(s)
    return cut_lineage(out)  # scored once, however often it is read


def arm_comparison(panel: DataFrame, arms: dict[str, tuple[Sequence[str], str]], label: str = "target", ret: str = "_fwd_ret", folds: int = 3, purge: int = 5) -> DataFrame:
    """Every arm (features, family) on the same rows and folds: out-of-sample IC, hit rate and mean signed return."""
    out = None
    need = sorted({f for fs, _ in arms.values() for f in fs})
    rows = cut_lineage(panel.dropna(subset=[*need, label]))
    for name, (fs, kind) in arms.items():
        s = walk_forward_scores(rows, fs, label, folds, purge, kind).withColumn("_s", F.col("p_up") - 0.5)
        g = s.filter(F.col(ret).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("_s") > 0) == (F.col(ret) > 0)).cast("double")).alias("hit_rate"), F.avg(F.signum("_s") * F.col(ret)).alias("mean_signed_return"))
        r = spearman(s, [], "_s", ret).drop("n").join(F.broadcast(g)).withColumn("arm", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


def label_comparison(panel: DataFrame, features: Sequence[str], labels: Sequence[str], ret: str = "_fwd_ret", folds: int = 3) -> DataFrame:
    """The same features and folds under different training labels, judged by the same forward return."""
    rows = panel.dropna(subset=[*features, *labels])
    out = None
    for lb in labels:
        r = arm_comparison(rows, {lb: (features, "gbt")}, lb, ret, folds)
        out = r if out is None else out.unionByName(r)
    return out


def tune(panel: DataFrame, features: Sequence[str], grid: Sequence[dict], label: str = "target", ret: str = "_fwd_ret", folds: int = 2) -> DataFrame:
    """Mean fold IC of every parameter set over time-ordered folds (never shuffled)."""
    out, panel = None, cut_lineage(panel)
    for i, p in enumerate(grid):
        s = walk_forward_scores(panel, features, label, folds, **p)
        ic = spearman(s, ["fold"], "p_up", ret).agg(F.avg("ic").alias("mean_ic"), F.count(F.lit(1)).alias("folds")).withColumns({"candidate": F.lit(i), "params": F.lit(str(sorted(p.items())))})
        out = ic if out is None else out.unionByName(ic)
    return out


def train_pools(panel: DataFrame, features: Sequence[str], pool: str, pools: Sequence[str], label: str = "target", kind: str = "logistic") -> dict[str, PipelineModel]:
    """One model per asset class plus the pooled one under the key ``pooled``."""
    panel = cut_lineage(panel)
    models = {p: train(panel.filter(F.col(pool) == p), features, label, kind) for p in pools}
    models["pooled"] = train(panel, features, label, kind)
    return models


def score_pools(models: dict[str, PipelineModel], df: DataFrame, pool: str) -> DataFrame:
    """Routes rows to their pool's model, others to the pooled one."""
    known = [p for p in models if p != "pooled"]
    out = score(models["pooled"], df.filter(~F.coalesce(F.col(pool).isin(*known), F.lit(False)))).withColumn("model", F.lit("pooled"))
    for p in known:
        out = out.unionByName(score(models[p], df.filter(F.col(pool) == p)).withColumn("model", F.lit(p)))
    return out


def score_latest(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Latest row of every symbol scored in one job."""
    rest = [c for c in features.columns if c != "symbol"]
    last = features.groupBy("symbol").agg(F.max_by(F.struct(*rest), "date").alias("_z")).select("symbol", "_z.*")
    return score(model, last)


def train_horizons(panels: dict[int, DataFrame], features: Sequence[str], label: str = "target", kind: str = "gbt", **params) -> dict[int, PipelineModel]:
    """One model per horizon from its own labelled panel."""
    return {h: train(cut_lineage(p), features, label, kind, **params) for h, p in panels.items()}


def score_horizons(models: dict[int, PipelineModel], latest: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """``latest`` with ``p_up_<h>`` of every horizon, their blend ``p_up``, its direction, confidence and ``n_horizons``, in one pass over the rows.

    The blend weighs the horizons that have a score (equally without ``weights``), so a missing one shifts its weight to the others; it is null where no
    horizon has a score.  A horizon without a weight counts nothing.
    """
    out = latest
    for h, m in models.items():
        out = score(m, out, f"p_up_{h}")
    part = [(F.col(f"p_up_{h}"), float((weights or {}).get(h, 0.0 if weights else 1.0))) for h in models]
    have = sum((F.when(p.isNotNull(), F.lit(w)).otherwise(0.0) for p, w in part), F.lit(0.0))
    total = sum((F.coalesce(p * w, F.lit(0.0)) for p, w in part), F.lit(0.0))
    blend = F.when(have > 0, total / have)
    out = out.withColumns({"p_up": blend, "n_horizons": sum((p.isNotNull().cast("int") for p, _ in part), F.lit(0))})
    up = F.col("p_up") > 0.5
    return out.withColumns({"direction": F.when(F.col("p_up").isNotNull(), F.when(up, "up").otherwise("down")), "confidence": F.greatest(F.col("p_up"), 1 - F.col("p_up"))})


def holdout_by_horizon(panels: dict[int, DataFrame], features: Sequence[str], label: str = "target", folds: int = 3, kind: str = "gbt", **params) -> DataFrame:
    """Out-of-sample scores of every horizon, with ``horizon``; each is purged by its own length."""
    out = None
    for h, p in panels.items():
        s = walk_forward_scores(p, features, label, folds, h, kind, **params).withColumn("horizon", F.lit(h))
        out = s if out is None else out.unionByName(s)
    return out


def factor_comparison(panel: DataFrame, base: Sequence[str], factors: Sequence[str], label: str = "target", ret: str = "_fwd_ret", folds: int = 3, kind: str = "gbt") -> DataFrame:
    """The base features with and without the factors, on the rows that have all of them and the same folds: per fold both ICs and what the factors add."""
    rows = cut_lineage(panel.dropna(subset=[*base, *factors, label]))
    arm = {}
    for name, cols in (("base", list(base)), ("factors", [*base, *factors])):
        s = walk_forward_scores(rows, cols, label, folds, kind=kind)
        arm[name] = spearman(s, ["fold"], "p_up", ret).select("fold", "n", F.col("ic").alias(f"ic_{name}"))
    return arm["base"].join(arm["factors"].drop("n"), "fold").withColumn("added", F.col("ic_factors") - F.col("ic_base"))


def retrain(model_features: Sequence[str], old: DataFrame, new: DataFrame, label: str = "target", kind: str = "logistic") -> PipelineModel:
    """Refit on the old rows plus the appended ones (Spark ML has no warm start)."""
    return train(old.unionByName(new), model_features, label, kind)


def fit_quality_classifier(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """A/B classifier and a quality-score regressor on a quality table; returns the scored rows."""
    v = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    cls = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=5, maxDepth=3, seed=7).fit(v)
    reg = GBTRegressor(featuresCol="_x", labelCol=label, predictionCol="_score", maxIter=5, maxDepth=3, seed=7).fit(v)
    s = reg.transform(cls.transform(v)).withColumn("p_a", vector_to_array("probability")[1])
    return s.withColumns({"quality_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_score"))) * 100, "level": F.when(F.col("p_a") >= 0.5, "A").otherwise("B")}).drop("_x", "prediction", "probability", "rawPrediction", "_score")


def date_fraction_cut(panel: DataFrame, fraction: float) -> DataFrame:
    """The first date at which ``fraction`` of the rows lies before it (one row)."""
    return date_offsets(panel).filter(F.col("before") >= F.col("total") * fraction).agg(F.min("date").alias("cut"))

