"""Portfolio plans, accounting, benchmark comparison and trade simulation.

Accounting windows run on one row per (key, date) or (key, symbol, date) on the common calendar, where a key is a plan,
draw or cost tier.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.joins import common_dates
from panelspark.operators.windows import Series

S = Series()
DAYS = 252


def _w(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))


def compound(r: Column, over=None) -> Column:
    """Product of (1 + r) through logs, exact in sign and zero for losses of 100 % or more."""
    x = 1 + r
    parts = [F.sum(F.log(F.abs(F.when(x != 0, x)))), F.sum((x < 0).cast("int")), F.max((x == 0).cast("int"))]
    logs, neg, zero = [p.over(over) if over is not None else p for p in parts]
    return F.when(zero == 1, 0.0).otherwise((1 - 2 * (neg % 2)) * F.exp(F.coalesce(logs, F.lit(0.0))))


def log_growth(r: Column) -> Column:
    """Sum of log(1 + r), null where a return reaches -100 %."""
    return F.when(F.min(r) > -1, F.sum(F.log1p(F.when(r > -1, r))))


def log_wealth(r: Column, over=None) -> Column:
    """Sum of log(1 + r): minus infinity from a loss of everything on, NaN from a greater loss on, whose debt has no growth."""
    x = 1 + r
    part = F.sum(F.when(x > 0, F.log(x)).when(x == 0, -math.inf).when(x < 0, math.nan))
    return part.over(over) if over is not None else part


def equal_weight_plan(signals: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Weight 1 for a bullish action with enough confidence, else 0."""
    bull = F.lower(F.col("action").cast("string")).isin("buy", "long", "1", "1.0")
    return signals.withColumn("target_weight", F.when(bull & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence), 1.0).otherwise(0.0))


def normalised(plan: DataFrame, raw: str, keys: Sequence[str] = ()) -> DataFrame:
    """Scales raw weights to sum 1 per date (0 where nothing is active)."""
    tot = F.sum(raw).over(Window.partitionBy(*keys, "date"))
    return plan.withColumn("target_weight", F.when(tot > 0, F.col(raw) / F.nullif(tot, F.lit(0.0))).otherwise(0.0))


def atr_inverse_plan(active: DataFrame, atr: DataFrame, window: int = 14) -> DataFrame:
    """Active weights proportional to 1 / ATR, zero in the warm-up rows of each plan."""
    j = active.join(atr.select("symbol", "date", "atr"), ["symbol", "date"])
    j = j.withColumn("_k", S.row())
    j = j.withColumn("_raw", F.when((F.col("_k") >= max(window - 1, 1) + 1) & (F.col("atr") > 0), F.col("target_weight") / F.col("atr")).otherwise(0.0))
    return normalised(j.drop("target_weight"), "_raw").drop("_raw", "_k", "atr")


def confidence_plan(active: DataFrame) -> DataFrame:
    """Active weights proportional to confidence."""
    return normalised(active.withColumn("_raw", F.col("target_weight") * F.coalesce("confidence", F.lit(0.0))).drop("target_weight"), "_raw").drop("_raw")


def plan_problems(plan: DataFrame, prices: DataFrame, min_dates: int = 3) -> DataFrame:
    """(reason, n) rows; an empty table means the plan can be accounted."""
    unknown = plan.select("symbol").distinct().join(prices.select("symbol").distinct(), "symbol", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown_symbol").alias("reason"), "n")
    w = F.col("target_weight")
    bad = plan.agg(F.sum(F.when((w < 0) | (w > 1) | w.isNull(), 1).otherwise(0)).alias("n")).select(F.lit("weight_out_of_range").alias("reason"), "n")
    dates = common_dates(plan, 1)
    few = dates.agg(F.when(F.count(F.lit(1)) < min_dates, 1).otherwise(0).alias("n")).select(F.lit("too_few_dates").alias("reason"), "n")
    gaps = plan.join(dates, "date", "left_semi").join(prices.select("symbol", "date", F.lit(1).alias("_p")), ["symbol", "date"], "left").agg(
        F.sum(F.col("_p").isNull().cast("int")).alias("n")).select(F.lit("price_gap").alias("reason"), "n")
    over = plan.groupBy("date").agg(F.sum("target_weight").alias("_s")).agg(F.sum((F.col("_s") > 1 + 1e-9).cast("int")).alias("n")).select(F.lit("total_above_one").alias("reason"), "n")
    u = unknown
    for d in (bad, few, gaps, over):
        u = u.unionByName(d)
    return u.withColumn("n", F.coalesce(F.col("n").cast("long"), F.lit(0)))


def account(plan: DataFrame, prices: DataFrame, cost: float | Column = 0.0, normalize: str | None = "equal_active", keys: Sequence[str] = ()) -> DataFrame:
    """Daily accounting: yesterday's weights earn today's close-to-close return, turnover pays the one-side cost.

    The calendar is the dates every plan symbol has; positions and lags are taken on it.
    """
    ks = list(keys)
    cal = common_dates(plan)
    p = plan.join(cal, "date", "left_semi").join(prices.select("symbol", "date", "close"), ["symbol", "date"])
    wt = F.col("target_weight")
    if normalize == "equal_active":
        day = Window.partitionBy(*ks, "date")
        n = F.sum((wt > 0).cast("int")).over(day)
        p = p.withColumn("_w", F.when(n > 0, wt / F.nullif(n, F.lit(0))).otherwise(0.0))
    else:
        p = p.withColumn("_w", wt)
    s = Window.partitionBy(*ks, "symbol").orderBy("date")
    p = p.withColumns({"_prev": F.coalesce(F.lag("_w").over(s), F.lit(0.0)), "_r": F.coalesce(F.col("close") / F.lag("close").over(s) - 1, F.lit(0.0))})
    d = p.groupBy(*ks, "date").agg(F.sum(F.col("_prev") * F.col("_r")).alias("gross"), F.sum(F.abs(F.col("_w") - F.col("_prev"))).alias("turnover"),
                                   F.sum((F.col("_w") > 0).cast("int")).alias("n_active"))
    c = cost if isinstance(cost, Column) else F.lit(float(cost))
    d = d.withColumn("cost", F.col("turnover") * c).withColumn("net", F.col("gross") - F.col("cost"))
    upto = _w(ks).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("equity", compound(F.col("net"), upto))
    return d.withColumn("drawdown", F.col("equity") / F.max("equity").over(upto) - 1)


def metrics(daily: DataFrame, keys: Sequence[str] = (), days: int = DAYS) -> DataFrame:
    """Return, volatility, Sharpe (population deviation), drawdown, cost drag and turnover of an accounted plan."""
    g = daily.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"), F.max_by("equity", "date").alias("_e"), log_growth(F.col("net")).alias("log_return"), F.avg("net").alias("_m"), F.stddev_pop("net").alias("_v"), F.min("drawdown").alias("max_drawdown"),
        F.sum("cost").alias("total_cost_drag"), F.avg("turnover").alias("avg_daily_turnover"), F.sum((F.col("n_active") > 0).cast("int")).alias("n_active_days"))
    return g.select(*keys, "n_days", (F.col("_e") - 1).alias("total_return"), "log_return", (F.exp(F.col("log_return") * days / F.col("n_days")) - 1).alias("annualized_return"),
                    (F.col("_v") * math.sqrt(days)).alias("annualized_vol"), F.when(F.col("_v") > 1e-12, F.col("_m") / F.nullif("_v", F.lit(0.0)) * math.sqrt(days)).alias("sharpe"),
                    "max_drawdown", "total_cost_drag", "avg_daily_turnover", "n_active_days")


def window_metrics(daily: DataFrame, segments: int, keys: Sequence[str] = ()) -> DataFrame:
    """Return and Sharpe per consecutive sub-window (remainder in the last)."""
    w = _w(keys)
    d = daily.withColumns({"_k": F.row_number().over(w.orderBy("date")) - 1, "_n": F.count(F.lit(1)).over(w)})
    d = d.withColumn("segment", F.least(F.floor(F.col("_k") / F.greatest(F.floor(F.col("_n") / segments), F.lit(1))), F.lit(segments - 1)).cast("int"))
    g = d.groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("n"), (compound(F.col("net")) - 1).alias("total_return"), log_growth(F.col("net")).alias("log_return"), F.avg("net").alias("_m"), F.stddev_pop("net").alias("_v"))
    return g.withColumn("sharpe", F.when(F.col("_v") > 1e-12, F.col("_m") / F.nullif("_v", F.lit(0.0)) * math.sqrt(DAYS))).drop("_m", "_v")


def period_returns(selections: DataFrame, bars: DataFrame, grid: DataFrame, h: int, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-weight ``h``-row return of the selected symbols per grid date, 0 for an empty date."""
    f = bars.withColumn("_f", S.lead("close", h) / F.col("close") - 1).select("symbol", "date", "_f")
    g = selections.join(grid, "date", "left_semi").join(f, ["symbol", "date"]).groupBy(*keys, "date").agg(F.avg("_f").alias("ret"))
    return _frame(grid, selections, keys).join(g, [*keys, "date"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))


def _frame(grid: DataFrame, selections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key with every grid date, built from the keys' distinct values attached to dates by explode."""
    if not keys:
        return grid
    ids = selections.select(F.struct(*keys).alias("_k")).distinct().agg(F.collect_list("_k").alias("_ks"))  # plans, draws: few
    return grid.join(F.broadcast(ids)).select("date", F.explode("_ks").alias("_k")).select("date", *[F.col(f"_k.{k}").alias(k) for k in keys])


def period_stats(r: DataFrame, h: int, keys: Sequence[str] = (), ret: str = "ret") -> DataFrame:
    """Mean, hit rate, compounded and annualised return, volatility and Sharpe of period returns; null under 8 periods."""
    g = r.filter(F.col(ret).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_periods"), F.avg(ret).alias("mean_per_period"), F.avg((F.col(ret) > 0).cast("double")).alias("period_hit_rate"),
                                                           log_growth(F.col(ret)).alias("_l"), compound(F.col(ret)).alias("_e"), F.stddev_pop(ret).alias("_s"))
    ok, per = F.col("n_periods") >= 8, DAYS / h
    out = {"mean_per_period": F.col("mean_per_period"), "period_hit_rate": F.col("period_hit_rate"), "total_return": F.col("_e") - 1,
           "annualized_return": F.exp(F.col("_l") * per / F.col("n_periods")) - 1, "annualized_vol": F.col("_s") * math.sqrt(per),
           "sharpe": F.when(F.col("_s") > 1e-12, F.col("mean_per_period") / F.nullif("_s", F.lit(0.0)) * math.sqrt(per))}
    return g.select(*keys, "n_periods", *[F.when(ok, e).alias(n) for n, e in out.items()])


def excess_stats(pair: DataFrame, cost: float | Column, keys: Sequence[str] = (), h: int = 5) -> DataFrame:
    """Net excess per period (signal - benchmark - 2 * one-side cost) with its t; null under 8 periods."""
    c = cost if isinstance(cost, Column) else F.lit(float(cost))
    d = pair.withColumn("_d", F.col("ret") - F.col("bench") - 2 * c)
    g = d.groupBy(*keys).agg(F.count("_d").alias("n_periods"), F.avg("_d").alias("_m"), F.stddev_samp("_d").alias("_s"))
    ok = F.col("n_periods") >= 8
    return g.select(*keys, "n_periods", F.when(ok, F.col("_m")).alias("excess_mean"), F.when(ok & (F.col("_s") > 1e-12), F.col("_m") / F.nullif("_s", F.lit(0.0)) * F.sqrt("n_periods")).alias("excess_t"),
                    F.when(ok, F.pow(1 + F.col("_m"), F.lit(DAYS / h)) - 1).alias("excess_annualized"))


def edge_verdict(excess: Column, t: Column, random_share: Column) -> Column:
    return (F.when(excess.isNull(), "unavailable").when(excess <= 0, "no_edge").when((t >= 2) & (random_share <= 0.10), "positive").otherwise("inconclusive"))


def single_asset(bars: DataFrame, position: str = "position") -> DataFrame:
    """Per symbol: lagged position times return, with total and annualised return, drawdown, win rate, holding rows."""
    d = bars.withColumns({"_r": S.pct("close"), "_p": S.lag(position)}).filter(F.col("_r").isNotNull()).withColumn("_s", F.col("_r") * F.col("_p"))
    upto = S.w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_l", F.sum(F.log1p("_s")).over(upto))  # a long or flat position cannot lose more than everything
    d = d.withColumn("_dd", F.exp(F.col("_l") - F.max("_l").over(upto)) - 1)
    g = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), log_growth(F.col("_s")).alias("_t"), compound(F.col("_s")).alias("_e"), F.min("_dd").alias("max_drawdown"), F.avg((F.col("_s") > 0).cast("double")).alias("win_rate"),
                                F.sum((F.col("_p") > 0).cast("int")).alias("holding_periods"))
    return g.select("symbol", (F.col("_e") - 1).alias("total_return"), F.col("_t").alias("log_return"), (F.exp(F.col("_t") * 252.0 / F.col("_n")) - 1).alias("annualized_return"), "max_drawdown", "win_rate", "holding_periods",
                    (F.col("_n") + 1).alias("total_periods"))


def hold_trades(signals: DataFrame, horizon: int, fee: float = 0.0005) -> DataFrame:
    """Greedy non-overlapping trades: a BUY/SELL opens, closes ``horizon`` rows later (or at the end), and the rows in
    between are skipped.  One grouped Arrow pass per symbol; a symbol's rows are bounded by its calendar."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("date", kind="mergesort")
        px, act, dt = p["close"].to_numpy(), p["action"].to_numpy(), p["date"].to_numpy()
        rows, i, n = [], 0, len(p)
        while i < n:
            j = min(i + horizon, n - 1)
            if act[i] in ("BUY", "SELL") and j > i:
                side = 1 if act[i] == "BUY" else -1
                rows.append((dt[i], dt[j], side, side * (px[j] / px[i] - 1) - 2 * fee))
                i = j + 1
            else:
                i += 1
        out = pd.DataFrame(rows, columns=["entry_date", "exit_date", "side", "ret"])
        out.insert(0, "symbol", p["symbol"].iloc[0])
        return out

    return signals.select("symbol", "date", "close", "action").groupBy("symbol").applyInPandas(run, "symbol string, entry_date date, exit_date date, side int, ret double")


def trade_metrics(trades: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("entry_date").rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("_e", compound(F.col("ret"), w))
    t = t.withColumn("_dd", 1 - F.col("_e") / F.greatest(F.max("_e").over(w), F.lit(1.0)))
    r = F.col("ret")
    g = t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_trades"), F.avg((r > 0).cast("double")).alias("win_rate"), F.avg(r).alias("avg_return"), compound(r).alias("_t"),
                                F.max("_dd").alias("max_drawdown"), F.sum(F.when(r > 0, r).otherwise(0.0)).alias("_gw"), F.sum(F.when(r <= 0, -r).otherwise(0.0)).alias("_gl"))
    pf = F.when(F.col("_gl") > 0, F.try_divide(F.col("_gw"), F.col("_gl"))).when(F.col("_gw") > 0, F.col("_gw") / 1e-6).otherwise(0.0)
    return g.select("symbol", "n_trades", "win_rate", "avg_return", (F.col("_t") - 1).alias("total_return"), "max_drawdown", pf.alias("profit_factor"))


def all_in_simulator(path: DataFrame, capital: float = 100000.0, fee: float = 0.001, rf: float = 0.03) -> DataFrame:
    """All-in long / flat simulation over a held position per symbol with whole-lot cash accounting and summary metrics."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("date", kind="mergesort")
        cash, units, trades, eq = capital, 0.0, 0, []
        for price, want in zip(p["price"].to_numpy(), p["position"].to_numpy(), strict=True):
            if want > 0 and units == 0:
                units = int(cash / (price * (1 + fee)))
                cash -= units * price * (1 + fee)
                trades += units > 0
            elif want <= 0 and units > 0:
                cash += units * price * (1 - fee)
                units, trades = 0.0, trades + 1
            eq.append(cash + units * price)
        e = pd.Series(eq)
        r = e.pct_change().dropna()
        total = e.iloc[-1] / capital - 1
        ann = (1 + total) ** (252 / max(len(e), 1)) - 1
        vol = r.std() * math.sqrt(252) if len(r) > 1 else 0.0
        return pd.DataFrame([{"symbol": p["symbol"].iloc[0], "final_equity": e.iloc[-1], "total_return": total, "annualized_return": ann,
                              "sharpe": (ann - rf) / vol if vol and vol > 0 else 0.0, "max_drawdown": float((e / e.cummax() - 1).min()), "trades": trades}])

    return path.select("symbol", "date", "price", "position").groupBy("symbol").applyInPandas(
        run, "symbol string, final_equity double, total_return double, annualized_return double, sharpe double, max_drawdown double, trades int")


def direction_baselines(bars: DataFrame, h: int) -> DataFrame:
    """Accuracy per symbol of the majority class, the last direction and always-up against the ``h``-row direction."""
    d = bars.withColumns({"y": (S.lead("close", h) > F.col("close")).cast("int"), "last": (F.col("close") > S.lag("close", h)).cast("int")}).filter(F.col("y").isNotNull())
    g = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("always_up"), F.avg((F.col("y") == F.col("last")).cast("double")).alias("last_direction"))
    return g.withColumn("majority", F.greatest(F.col("always_up"), 1 - F.col("always_up")))


def consistency(evidence: DataFrame) -> DataFrame:
    """Agreement of hit-rate edge and profit per symbol; disagreeing symbols are flagged."""
    good, profit = F.col("hit_rate") > 0.5, F.col("total_return") > 0
    return evidence.withColumn("divergent", (good != profit).cast("int"))


def topk_dropout(scores: DataFrame, topk: int, n_drop: int, hold: int, score: str = "p_up", keys: Sequence[str] = ("plan",)) -> DataFrame:
    """Holdings per date of a top-k portfolio that sells at most ``n_drop`` worst names held at least ``hold`` dates.

    Sequential over dates, so one grouped Arrow pass per plan: (dates x pool size) rows per plan, plans in parallel.
    """
    def run(p: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, int] = {}
        out = []
        for d, g in p.sort_values(["date", "rank"], kind="mergesort").groupby("date", sort=True):
            rank = dict(zip(g["symbol"], g["rank"], strict=True))
            order = list(rank)
            for s in held:
                held[s] += 1
            worst = sorted((s for s in held if held[s] >= hold), key=lambda s: (-rank.get(s, 1 << 30), s))
            fresh = [s for s in order if s not in held]
            for s in worst[:n_drop]:
                if fresh and rank.get(fresh[0], 1 << 30) < rank.get(s, 1 << 30):
                    del held[s]
                    held[fresh.pop(0)] = 0
            for s in fresh:
                if len(held) >= topk:
                    break
                held[s] = 0
            out += [(d, s) for s in held]
        r = pd.DataFrame(out, columns=["date", "symbol"])
        for k in keys:
            r[k] = p[k].iloc[0]
        return r[[*keys, "date", "symbol"]]

    day = Window.partitionBy(*keys, "date").orderBy(F.desc(score), "symbol")
    ranked = scores.filter(F.col(score).isNotNull()).select(*keys, "date", "symbol", F.row_number().over(day).alias("rank"))
    types = dict(scores.dtypes)
    return ranked.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", date date, symbol string")
