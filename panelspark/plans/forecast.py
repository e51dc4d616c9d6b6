"""Forecast-table queries (RM2, RM4-RM7, AG20, AG21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import forecast as fc
from panelspark.operators.windows import rnd
from panelspark.plans import sqltext as q
from panelspark.plans.registry import query
from panelspark.sources import derive

FT = f"""ft0 as (select symbol, date, close, row_number() over ({q.W}) as rn, ln(close / {q.lag('close')}) as lr from bars), ft1 as (select *, avg(lr) over ({q.W} rows between 59 preceding and current row) as mu from ft0),
  ft as (select o.symbol, o.rn as origin, o.close as last_close, b.rn - o.rn as step, b.date, b.close as price, o.close * exp(o.mu * (b.rn - o.rn)) as forecast from ft1 o join ft1 b on b.symbol = o.symbol and b.rn between o.rn + 1 and o.rn + 10 where o.rn >= 60 and (o.rn - 60) % 10 = 0)"""


def table(spark, sf):
    b = derive.bars(spark, sf)
    return fc.drift_forecast(fc.rolling_origins(b, 10, 10, 60), b, 60)


@query("rolling_forecasts", "RM2", f"with {q.BARS}, {FT} select symbol, origin, step, {q.D}, {q.rs(4, last_close='last_close', price='price', forecast='forecast')} from ft")
def rolling_forecasts(spark, sf):
    return rnd(table(spark, sf).select("symbol", "origin", "step", "date", "last_close", "price", "forecast"), 4)


@query("forecast_errors", "AG20", f"with {q.BARS}, {FT}, d as (select *, coalesce(lag(price) over (partition by symbol, origin order by step), last_close) as pv from ft) select symbol, count(*) as n, {q.rs(5, mape='avg(abs(forecast / price - 1))', within_5pct='avg((abs(forecast / price - 1) <= 0.05)::int)', direction_accuracy='avg(((forecast > pv) = (price > pv))::int)', correlation='corr(forecast, price)')} from d group by 1")
def forecast_errors(spark, sf):
    return rnd(fc.forecast_errors(table(spark, sf)), 5)


@query("path_signals", "AG21", f"with {q.BARS}, {FT} select symbol, origin, {q.rs(4, last='arg_max(forecast, step) - any_value(last_close)', mean='avg(forecast) - any_value(last_close)', high='max(forecast) - any_value(last_close)', low='min(forecast) - any_value(last_close)')} from ft group by 1, 2")
def path_signals(spark, sf):
    return rnd(fc.path_signals(table(spark, sf)), 4)


@query("smoothed_paths", "RM4", f"with {q.BARS}, {FT} select symbol, origin, step, {q.r('avg(price) over (partition by symbol, origin order by step rows between 1 preceding and 1 following) * (1 + 0.02 * step / 10.0)', 4, 'smoothed')} from ft")
def smoothed_paths(spark, sf):
    return rnd(fc.smooth_path(table(spark, sf), 10, trend=0.02).select("symbol", "origin", "step", "smoothed"), 4)


@query("recent_trend", "RM5", f"""with {q.BARS}, x as (select *, row_number() over ({q.W}) as i from bars), y as (select *, {q.mx('close', 20)} - {q.mn('close', 20)} as rg, {q.avg('close', 20)} as ma, case when i >= 20 then regr_slope(close, i) over ({q.W} rows between 19 preceding and current row) end as sl from x)
  select symbol, {q.D}, {q.rs(5, trend='sl * 20 / nullif(rg, 0)', strength='abs(sl) * 20 / ma')} from y""")
def recent_trend(spark, sf):
    return rnd(fc.recent_trend(derive.bars(spark, sf)).select("symbol", "date", "trend", "strength"), 5)


@query("event_adjustment", "RM6", f"with {q.BARS}, e as (select distinct date_trunc('year', date)::date as s from bars), a as (select distinct cast(s + cast(i as integer) as date) as date from e, range(0, 5) t(i)) select symbol, {q.D}, {q.r('close * case when a.date is null then 1 else 0.98 end', 4, 'adjusted')} from bars left join a using (date)")
def event_adjustment(spark, sf):
    b = derive.bars(spark, sf)
    e = b.select(F.trunc("date", "year").alias("end")).distinct().withColumn("factor", F.lit(0.98))
    return rnd(fc.event_adjustment(b, e, 5).select("symbol", "date", "adjusted"), 4)


@query("forecast_bounds", "RM7", f"with {q.BARS}, {FT} select symbol, origin, step, (forecast < last_close * 0.7 or forecast > last_close * 1.3)::int as out_of_bounds, {q.r('greatest(last_close * 0.7, least(last_close * 1.3, forecast))', 4, 'clamped')} from ft")
def forecast_bounds(spark, sf):
    return rnd(fc.bound_check(table(spark, sf)).select("symbol", "origin", "step", "out_of_bounds", "clamped"), 4)
