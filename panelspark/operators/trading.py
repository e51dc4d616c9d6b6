"""Decision feeds, signals, sizing, stop/take advice, orders, gates and release checks, all symbols at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.windows import clip

HORIZON_WEIGHTS = {5: 0.5, 10: 0.3, 20: 0.2}


def aggregate_horizons(preds: DataFrame, weights: dict[int, float] = HORIZON_WEIGHTS, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Blended P(up) with weights re-normalised over the horizons present, weight coverage and the missing horizons."""
    m = F.create_map(*[x for h, w in weights.items() for x in (F.lit(h), F.lit(float(w)))])
    w = F.try_element_at(m, F.col("horizon"))
    d = preds.filter(F.col("p_up").isNotNull() & w.isNotNull()).withColumn("_w", w)
    total = float(sum(weights.values()))
    g = d.groupBy(*keys).agg((F.sum(F.col("_w") * F.col("p_up")) / F.sum("_w")).alias("p_up"), (F.sum("_w") / total).alias("coverage"), F.collect_set("horizon").alias("_h"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(h) for h in weights]), F.col("_h")))
    return g.withColumn("missing", F.concat_ws(",", F.transform(missing, lambda x: x.cast("string")))).drop("_h")


def advisory(p: str = "p_up", threshold: float = 0.2) -> Column:
    """bullish / bearish / withhold by confidence 2|p - 0.5|."""
    c = 2 * F.abs(F.col(p) - 0.5)
    return F.when(c < threshold, "withhold").when(F.col(p) > 0.5, "bullish").otherwise("bearish")


def decision_feed(preds: DataFrame, audit: DataFrame, calibrate: Column | None = None, threshold: float = 0.2, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Blend, calibrated probability, advice and the symbol's audited hit rate."""
    f = aggregate_horizons(preds, keys=keys)
    f = f.withColumn("calibrated", calibrate if calibrate is not None else F.col("p_up"))
    f = f.withColumns({"confidence": 2 * F.abs(F.col("calibrated") - 0.5), "advice": advisory("calibrated", threshold)})
    return f.join(audit.select("symbol", F.col("hit_rate").alias("audit_hit_rate"), F.col("verified").alias("audit_n")), "symbol", "left")


def portfolio_summary(preds: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """One row per symbol with the latest P(up) of every horizon."""
    last = preds.groupBy("symbol", "horizon").agg(F.max_by("p_up", "date").alias("p_up"))
    w = last.groupBy("symbol").pivot("horizon", list(horizons)).agg(F.first("p_up"))
    return w.withColumnsRenamed({str(h): f"p_up_{h}" for h in horizons})


def build_signal(preds: DataFrame, weights: dict[int, float] = HORIZON_WEIGHTS, keys: Sequence[str] = ("symbol", "date"), buy: float = 0.25, sell: float = -0.25, allow_short: bool = True) -> DataFrame:
    """Weighted direction score, action, confidence and consensus.  Broken probabilities count as neutral."""
    m = F.create_map(*[x for h, w in weights.items() for x in (F.lit(h), F.lit(float(w)))])
    w = F.coalesce(F.try_element_at(m, F.col("horizon")), F.lit(0.0))
    ok = F.col("p_up").between(0, 1)
    dv = 2 * (F.when(ok, F.col("p_up")).otherwise(0.5) - 0.5)
    d = preds.withColumns({"_w": w, "_d": dv})
    g = d.groupBy(*keys).agg(F.sum(F.col("_d") * F.col("_w")).alias("_s"), (F.sum(F.when(ok, F.abs("_d") * F.col("_w"))) / F.nullif(F.sum(F.when(ok, F.col("_w"))), F.lit(0.0))).alias("confidence"),
                             F.sum((F.col("_d") > 0).cast("int")).alias("_p"), F.sum((F.col("_d") < 0).cast("int")).alias("_n"))
    s = clip("_s", -1, 1)
    action = F.when(s >= buy, "BUY").when(s <= sell, "SELL" if allow_short else "HOLD").otherwise("HOLD")
    cons = (F.when(F.col("_p") > F.col("_n"), "up").when(F.col("_n") > F.col("_p"), "down").when(s > 0, "lean_up").when(s < 0, "lean_down").otherwise("neutral"))
    return g.select(*keys, s.alias("score"), F.abs(s).alias("strength"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), action.alias("action"), cons.alias("consensus"))


def size_positions(signals: DataFrame, method: str = "fixed", capital: float = 1_000_000.0, base: float = 0.1, max_pct: float = 0.2, max_kelly: float = 0.25, stop: float = 0.03, take: float = 0.06) -> DataFrame:
    """Position fraction and amount, whole quantity (at least 1), stop and take prices; nothing for HOLD."""
    st, cf = (F.least(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) for c in ("strength", "confidence"))
    if method == "kelly":
        p = F.greatest(F.lit(0.5), F.least(F.lit(0.95), F.coalesce("confidence", F.lit(0.5))))
        b = take / max(stop, 1e-6)
        frac = clip((p * b - (1 - p)) / b, 0, max_kelly)
    else:
        frac = clip(base * (0.5 + st * 0.5) * (0.5 + cf * 0.5), 0, max_pct)
    live, long = F.col("action") != "HOLD", F.col("action") == "BUY"
    frac = F.when(live, frac).otherwise(0.0)
    amount = frac * capital
    px = F.when(F.col("close") > 0, F.col("close"))
    qty = F.when(live & px.isNotNull(), F.when(amount > 0, F.greatest(F.floor(amount / px), F.lit(1))).otherwise(0))
    side = F.when(long, 1).otherwise(-1)
    return signals.withColumns({"position_pct": frac, "position_amount": amount, "qty": qty, "stop_price": F.when(live, px * (1 - side * stop)), "take_price": F.when(live, px * (1 + side * take))})


def advise(state: DataFrame, allowed: Column | bool = True, min_bars: int = 30, atr_mult: float = 2.0, buffer: float = 0.005, min_stop: float = 0.01, max_stop: float = 0.10,
           min_rr: float = 1.5, vol_target: float = 0.02) -> DataFrame:
    """Stop and take from ATR and structure.  ``state``: symbol, action, close, atr, support, resistance, bars, position_pct."""
    e, a, sup, res = (F.col(c) for c in ("close", "atr", "support", "resistance"))
    long = F.col("action") == "BUY"
    status = (F.when(F.col("action") == "HOLD", "withheld").when(F.col("bars") < min_bars, "unavailable").when(e.isNull() | (e <= 0), "unavailable")
              .when(a.isNull() | (a <= 0), "unavailable").when(sup.isNull() | res.isNull() | (sup <= 0), "unavailable")
              .when(~(allowed if isinstance(allowed, Column) else F.lit(allowed)), "withheld").otherwise("ok"))
    d = state.withColumn("status", status)
    ok = F.col("status") == "ok"
    structural = F.when(long, sup * (1 - buffer)).otherwise(res * (1 + buffer))
    by_atr = F.when(long, e - atr_mult * a).otherwise(e + atr_mult * a)
    raw = F.when(long, F.least(structural, by_atr)).otherwise(F.greatest(structural, by_atr))
    d = d.withColumns({"_sp": F.when(ok, clip(F.abs(e - raw) / e, min_stop, max_stop)), "_basis": F.when(ok, F.when(F.when(long, structural <= by_atr).otherwise(structural >= by_atr), "structure").otherwise("atr"))})
    sp = F.col("_sp")
    rr_take = F.when(long, e * (1 + min_rr * sp)).otherwise(e * (1 - min_rr * sp))
    cap = F.when(long, F.when(res > e, res * (1 + buffer))).otherwise(F.when(sup < e, sup * (1 - buffer)))
    take = F.when(long, F.least(rr_take, F.coalesce(cap, rr_take))).otherwise(F.greatest(rr_take, F.coalesce(cap, rr_take)))
    d = d.withColumn("suggested_take", F.when(ok, take))
    tp = F.abs(F.col("suggested_take") - e) / e
    scale = F.when(a > 0, F.least(vol_target / (a / e), F.lit(1.0)))
    return d.withColumns({"suggested_stop": F.when(long, e * (1 - sp)).otherwise(e * (1 + sp)), "stop_pct": sp, "take_pct": tp, "risk_reward": tp / F.nullif(sp, F.lit(0.0)), "stop_basis": F.col("_basis"),
                          "vol_scaled_position": F.when(ok, F.col("position_pct") * scale)}).drop("_sp", "_basis")


def order_rows(budget: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Main order plus stop and take conditionals of every sized signal."""
    side = F.when(F.col("action") == "BUY", "buy").otherwise("sell")
    back = F.when(F.col("action") == "BUY", "sell").otherwise("buy")
    none = F.lit(None).cast("double")

    def order(kind, s, price, reduce_only):
        return F.struct(F.lit(kind).alias("kind"), s.alias("side"), price.alias("price"), F.lit(reduce_only).alias("reduce_only"))

    rows = F.array_compact(F.array(order("main", side, none, 0), F.when(F.col("stop_price").isNotNull(), order("stop_loss", back, F.col("stop_price"), 1)),
                                   F.when(F.col("take_price").isNotNull(), order("take_profit", back, F.col("take_price"), 1))))
    live = budget.filter((F.col("action") != "HOLD") & (F.col("qty") > 0))
    return live.select(*keys, "qty", F.explode(rows).alias("_o")).select(*keys, "qty", "_o.*")


def strategy_gate(horizons: DataFrame, audit: DataFrame, keys: Sequence[str] = (), min_audit: int = 30, min_hit: float = 0.5) -> DataFrame:
    """All horizons pass and the audit passes; the failing parts are listed."""
    h = horizons.groupBy(*keys).agg(F.every(F.col("passed") == 1).alias("_h"), F.array_sort(F.collect_list(F.when(F.col("passed") == 0, F.col("horizon")))).alias("_bad"))
    a = audit.select(*keys, (F.col("verified") >= min_audit).alias("_n"), (F.col("hit_rate") >= min_hit).alias("_r"))
    j = h.join(a, list(keys)) if keys else h.join(F.broadcast(a))
    reasons = F.array_compact(F.array(F.when(F.size("_bad") > 0, F.concat(F.lit("horizons:"), F.concat_ws("|", F.transform("_bad", lambda x: x.cast("string"))))),
                                      F.when(~F.col("_n"), F.lit("audit_samples")), F.when(~F.col("_r"), F.lit("audit_hit_rate"))))
    return j.select(*keys, (F.col("_h") & F.col("_n") & F.col("_r")).cast("int").alias("gated"), F.concat_ws(",", reasons).alias("reasons"))


def release_checks(state: DataFrame, asof: str, max_age: int = 5, min_rows: int = 100) -> DataFrame:
    """(symbol, rule, severity) for stale data, short history and missing values; severity 0 ok, 1 warning, 2 error."""
    age = F.datediff(F.lit(asof).cast("date"), "last_date")
    rules = F.array(F.struct(F.lit("stale").alias("rule"), F.when(age > 10 * max_age, 2).when(age > max_age, 1).otherwise(0).alias("severity")),
                    F.struct(F.lit("history").alias("rule"), F.when(F.col("rows") < min_rows, 2).when(F.col("rows") < 2 * min_rows, 1).otherwise(0).alias("severity")),
                    F.struct(F.lit("nulls").alias("rule"), F.when(F.col("nulls") > 0.5 * F.col("rows"), 2).when(F.col("nulls") > 0, 1).otherwise(0).alias("severity")))
    return state.select("symbol", F.explode(rules).alias("_r")).select("symbol", "_r.*")


def route_alerts(checks: DataFrame) -> DataFrame:
    """Worst severity per symbol and its channel."""
    g = checks.groupBy("symbol").agg(F.max("severity").alias("severity"), F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("severity") > 0, F.col("rule"))))).alias("rules"))
    return g.withColumn("channel", F.when(F.col("severity") == 2, "page").when(F.col("severity") == 1, "digest").otherwise("none"))
