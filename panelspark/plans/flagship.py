"""Derive bars, score them, and measure the score: rank correlation with the 5-row forward return per symbol."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import order_stats
from panelspark.operators.windows import rnd
from panelspark.plans import sqltext as q
from panelspark.plans.registry import query
from panelspark.sources import derive


@query("signal_ic_by_symbol", "ST1 LB2 TI1",
       f"with {q.SCORES} select symbol, n, {q.r('ic', 6, 'ic')} from ("
       + q.spearman("(select * from scores where horizon = 5)", "symbol", "p_up", "fwd_ret") + ")")
def signal_ic_by_symbol(spark, sf):
    s = derive.scores(derive.bars(spark, sf), horizons=(5,))
    return rnd(order_stats.spearman(s, ["symbol"], "p_up", "fwd_ret", bounded=True))


@query("pooled_ic_by_horizon", "ST1",
       f"with {q.SCORES} select horizon, n, {q.r('ic', 6, 'ic')} from ("
       + q.spearman("scores", "horizon", "p_up", "fwd_ret") + ")")
def pooled_ic_by_horizon(spark, sf):
    s = derive.scores(derive.bars(spark, sf))
    return rnd(order_stats.spearman(s, ["horizon"], "p_up", "fwd_ret"))


@query("bars_daily", "SRC1 SE1",
       f"with {q.BARS} select symbol, {q.D}, {q.rs(6, open='open', high='high', low='low', close='close', volume='volume')} from bars")
def bars_daily(spark, sf):
    return rnd(derive.bars(spark, sf))


@query("bars_hourly", "ST-R8",
       f"with {q.HOUR} select symbol, {q.TS}, {q.rs(6, open='open', high='high', low='low', close='close', volume='volume')} from hour")
def bars_hourly(spark, sf):
    return rnd(derive.hour_bars(spark, sf))


@query("pooled_ic_bucketed", "ST1", "with " + q.BARS + f"""
    select n, {q.r('ic', 6, 'ic')} from ({q.spearman(f"(select volume as v, close / open - 1 as body from bars)", "", "v", "body")})""")
def pooled_ic_bucketed(spark, sf):
    """One group holding every row, ranked through value buckets whatever the input size."""
    b = derive.bars(spark, sf).select(F.col("volume").alias("v"), (F.col("close") / F.col("open") - 1).alias("body"))
    return rnd(order_stats.spearman(b, [], "v", "body"))


@query("pooled_quantiles_bucketed", "CA6", """
    select segment, prob, """ + q.r("q", 6, "q") + """ from (
      select l_returnflag as segment, unnest([0.05, 0.5, 0.95]) as prob,
        unnest(quantile_cont(l_extendedprice / l_quantity, [0.05, 0.5, 0.95])) as q from lineitem group by 1)""")
def pooled_quantiles_bucketed(spark, sf):
    li = derive.table(spark, sf, "lineitem")
    x = li.select(F.col("l_returnflag").alias("segment"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))
    return rnd(order_stats.quantiles(x, ["segment"], "px", [0.05, 0.5, 0.95]))


@query("tick_positions_bucketed", "SO1", """
    select event_id, event_type as symbol, row_number() over (partition by event_type order by ts, event_id) as pos from events""")
def tick_positions_bucketed(spark, sf):
    t = derive.ticks(spark, sf).select("symbol", "ts", "event_id")
    return order_stats.positions(t, ["symbol"], ["ts", "event_id"]).select("event_id", "symbol", "pos")
