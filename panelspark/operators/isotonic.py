"""Isotonic and logistic calibration as data: thresholds and coefficients are tables, applied by joins, for any number of groups at once.

Isotonic: equal scores are merged, a group's scores are cut into buckets of the order, pool-adjacent-violators pools each bucket, and the blocks that are left
are pooled across the buckets.  Pooling may be done in any order, so the result is that of one pass; a bucket leaves few blocks, so only these meet.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.calibration import calibration_errors, logit
from panelspark.operators.joins import asof_join
from panelspark.operators.order_stats import bucketed, join_same
from panelspark.session import cut_lineage, ship

BLOCK = "lo double, hi double, s double, n double"


def pool(blocks: pd.DataFrame) -> pd.DataFrame:
    """Adjacent blocks (lo, hi, sum, weight) whose means do not rise become one."""
    b = blocks.sort_values("lo")
    lo, hi, s, n = (b[c].to_numpy(float) for c in ("lo", "hi", "s", "n"))
    out: list[list[float]] = []
    for row in zip(lo, hi, s, n, strict=True):
        out.append(list(row))
        # means compared by products: no rounding for whole numbers
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, h, a, w = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = h, out[-1][2] + a, out[-1][3] + w
    return pd.DataFrame(np.array(out).reshape(-1, 4), columns=["lo", "hi", "s", "n"])


def _pooled(df: DataFrame, by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    fields = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = pool(g)
        for c in keep:
            out.insert(0, c, [g[c].iloc[0]] * len(out))
        return out[[*keep, "lo", "hi", "s", "n"]]

    return df.groupBy(*by).applyInPandas(run, ", ".join([*[f"`{c}` {fields[c]}" for c in keep], BLOCK]))


def fit_isotonic(df: DataFrame, keys: Sequence[str], p: str = "p_up", y: str = "y") -> DataFrame:
    """(keys, lo, hi, value, n): the blocks of the non-decreasing fit of ``y`` on ``p``; rows with a null or NaN in either are left out."""
    ship(df.sparkSession)
    x = df.select(*keys, F.col(p).cast("double").alias("lo"), F.col(y).cast("double").alias("_y")).where("lo is not null and _y is not null and not isnan(lo) and not isnan(_y)")
    each = x.groupBy(*keys, "lo").agg(F.sum("_y").alias("s"), F.count("*").cast("double").alias("n")).withColumn("hi", F.col("lo"))
    ks = list(keys) or ["_all"]
    cut = bucketed(each, keys, ["lo"]).withColumn("_b", F.concat_ws("-", "_b"))
    first = _pooled(cut, [*ks, "_b"], ks)
    out = _pooled(first, ks, ks)
    return out.select(*keys, "lo", "hi", (F.col("s") / F.col("n")).alias("value"), F.col("n").cast("long").alias("n"))


def apply_isotonic(df: DataFrame, blocks: DataFrame, keys: Sequence[str], p: str = "p_up", name: str = "calibrated") -> DataFrame:
    """Adds the fitted value at ``p``: a block's inside it, linear between blocks, flat outside; null for a null ``p`` or a group without fit."""
    w = Window.partitionBy(*keys).orderBy("_at") if keys else Window.orderBy("_at")  # blocks of a group, not its rows
    ends = F.array(F.struct(F.col("lo").alias("x")), F.struct(F.col("hi").alias("x")))
    edge = blocks.select(*keys, F.explode(F.array_distinct(ends)).alias("e"), F.col("value").alias("_v")).select(*keys, F.col("e.x").alias("_at"), "_v")
    edge = edge.withColumns({"_x": F.col("_at"), "_x1": F.lead("_at").over(w), "_v1": F.lead("_v").over(w)})
    low = blocks.groupBy(*keys).agg(F.min_by("value", "lo").alias("_v")) if keys else blocks.agg(F.min_by("value", "lo").alias("_v")).where("_v is not null")
    none = F.lit(None).cast("double")
    table = edge.unionByName(low.select(*keys, F.lit(float("-inf")).alias("_at"), "_v", F.lit(float("-inf")).alias("_x"), none.alias("_x1"), none.alias("_v1")))
    joined = asof_join(df.withColumn("_at", F.col(p).cast("double")), table, keys, "_at", ["_v", "_x", "_x1", "_v1"])
    v, x, x1, v1 = (F.col(f"asof_{c}") for c in ("_v", "_x", "_x1", "_v1"))
    between = v + (v1 - v) * (F.col(p) - x) / (x1 - x)
    value = F.when(F.col(p).isNull(), None).when(x1.isNull() | (F.col(p) <= x), v).otherwise(between)
    return joined.withColumn(name, value).drop("_at", "asof__at", "asof__v", "asof__x", "asof__x1", "asof__v1")


def fit_platt(df: DataFrame, keys: Sequence[str], p: str = "p_up", y: str = "y", rounds: int = 30, tol: float = 1e-10) -> DataFrame:
    """(keys, slope, intercept) of the logistic curve of ``y`` on the logit of ``p``: Newton steps of all groups together, each one aggregate of five sums."""
    ks = list(keys) or ["_all"]
    d = df if keys else df.withColumn("_all", F.lit(1))
    x = cut_lineage(d.select(*ks, logit(p).alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null"))
    c = x.groupBy(*ks).agg(F.avg("_y").alias("_m")).select(*ks, F.lit(0.0).alias("slope"), F.log((F.col("_m") + 1e-6) / (1 - F.col("_m") + 1e-6)).alias("intercept"), F.lit(1.0).alias("_step"))
    c = cut_lineage(c)
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-(F.col("slope") * F.col("_x") + F.col("intercept"))))
        h, g = q * (1 - q), F.col("_y") - q
        s = join_same(x, c, ks).groupBy(*ks, "slope", "intercept").agg(F.sum(g * F.col("_x")).alias("ga"), F.sum(g).alias("gb"), F.sum(h * F.col("_x") * F.col("_x")).alias("aa"), F.sum(h * F.col("_x")).alias("ab"), F.sum(h).alias("bb"))
        det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
        da, db = F.try_divide(F.col("bb") * F.col("ga") - F.col("ab") * F.col("gb"), det), F.try_divide(F.col("aa") * F.col("gb") - F.col("ab") * F.col("ga"), det)
        step = s.select(*ks, "slope", "intercept", F.coalesce(da, F.lit(0.0)).alias("da"), F.coalesce(db, F.lit(0.0)).alias("db"))
        c = cut_lineage(step.select(*ks, (F.col("slope") + F.greatest(F.lit(-3.0), F.least(F.lit(3.0), "da"))).alias("slope"), (F.col("intercept") + F.greatest(F.lit(-3.0), F.least(F.lit(3.0), "db"))).alias("intercept"), (F.abs("da") + F.abs("db")).alias("_step")))
        if not c.where(F.col("_step") > tol).limit(1).count():
            break
    return c.select(*keys, "slope", "intercept")


def calibrate_and_evaluate(calibration: DataFrame, verify: DataFrame, keys: Sequence[str], p: str = "p_up", y: str = "y", legs: Sequence[str] = ("base", "platt", "isotonic")) -> DataFrame:
    """(keys, leg, n, brier, ece) of the raw score and of the calibrations fitted on the earlier segment, over the later one."""
    rows = verify.select(*keys, p, y).where(F.col(p).isNotNull() & F.col(y).isNotNull())
    cols = [F.struct(F.lit("base").alias("leg"), F.col(p).cast("double").alias("q"))] if "base" in legs else []
    if "isotonic" in legs:
        rows = apply_isotonic(rows, fit_isotonic(calibration, keys, p, y), keys, p, "_iso")
        cols.append(F.struct(F.lit("isotonic").alias("leg"), F.col("_iso").alias("q")))
    if "platt" in legs:
        fit = fit_platt(calibration, keys, p, y)
        rows = join_same(rows, fit, keys) if keys else rows.join(F.broadcast(fit))  # one row
        cols.append(F.struct(F.lit("platt").alias("leg"), (1 / (1 + F.exp(-(logit(p) * F.col("slope") + F.col("intercept"))))).alias("q")))
    x = rows.select(*keys, y, F.explode(F.array(*cols)).alias("_x")).select(*keys, y, "_x.leg", "_x.q")
    return calibration_errors(x, [*keys, "leg"], "q", y)
