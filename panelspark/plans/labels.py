"""Label and cross-section queries (LB*, XS*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import aggregates as ag
from panelspark.operators import indicators as ti
from panelspark.operators import labels as lb
from panelspark.operators.windows import Series, rnd
from panelspark.plans import sqltext as q
from panelspark.plans.registry import query
from panelspark.sources import derive


@query("binary_target", "LB1 LB2", f"with {q.BARS} select symbol, {q.D}, case when {q.lead('close', 5)} is not null then ({q.lead('close', 5)} > close)::int end as target_5d, {q.rs(6, fwd_1=q.lead('close', 1) + ' / close - 1', fwd_5=q.lead('close', 5) + ' / close - 1', fwd_20=q.lead('close', 20) + ' / close - 1')} from bars")
def binary_target(spark, sf):
    d = lb.forward_returns(lb.binary_target(derive.bars(spark, sf), 5), [1, 5, 20])
    return rnd(d.select("symbol", "date", "target_5d", "fwd_1", "fwd_5", "fwd_20"))


TB = f"""lv0 as (select *, ln(close / {q.lag('close')}) as lr from bars), lv as (select *, case when count(*) over ({q.W} rows between 19 preceding and current row) >= 5 then stddev_samp(lr) over ({q.W} rows between 18 preceding and current row) end as sigma,
   row_number() over ({q.W}) as rn, {q.lead('close', 10)} as fin from lv0),
  hit as (select a.symbol, a.rn, arg_min(case when b.high >= a.close * (1 + 1.5 * a.sigma) and b.low <= a.close * (1 - 1.5 * a.sigma) then 0 when b.high >= a.close * (1 + 1.5 * a.sigma) then 1 else -1 end, b.rn) as x
   from lv a join lv b on a.symbol = b.symbol and b.rn between a.rn + 1 and a.rn + 10 and (b.high >= a.close * (1 + 1.5 * a.sigma) or b.low <= a.close * (1 - 1.5 * a.sigma)) group by 1, 2),
  tb as (select lv.symbol, date, lv.close, case when sigma is not null and fin is not null then coalesce(x, cast(sign(fin - close) as int)) end as tb_label from lv left join hit using (symbol, rn))"""


def _tb(spark, sf):
    return lb.triple_barrier(ti.label_volatility(derive.bars(spark, sf)))


@query("triple_barrier", "LB3 LB4", f"with {q.BARS}, {TB} select symbol, {q.D}, tb_label, case tb_label when 1 then 1 when -1 then 0 end as binary from tb")
def triple_barrier(spark, sf):
    return rnd(_tb(spark, sf).select("symbol", "date", "tb_label", lb.to_binary("tb_label").alias("binary")))


@query("label_summary", "AG3", f"""with {q.BARS}, {TB}, g as (select symbol, count(*) filter (where tb_label = 1) as up, count(*) filter (where tb_label = -1) as down, count(*) filter (where tb_label = 0) as neutral, count(*) filter (where tb_label is null) as pending from tb group by 1)
  select symbol, up, down, neutral, pending, up + down + neutral as labeled, {q.rs(6, up_ratio='up::double / (up + down + neutral)', down_ratio='down::double / (up + down + neutral)', neutral_ratio='neutral::double / (up + down + neutral)')} from g""")
def label_summary(spark, sf):
    return rnd(lb.label_summary(_tb(spark, sf)))


RISK = f"""rk0 as (select *, close / {q.lag('close')} - 1 as r from bars), risk as (select symbol, date, close, case when count(close) over a >= 10 then stddev_samp(r) over a end * sqrt(10.0) as fwd_vol,
   case when count(close) over a >= 10 then min(close) over a end / close - 1 as fwd_mdd, {q.sd('r', 20)} * sqrt(10.0) as trail_vol from rk0 window a as ({q.W} rows between 1 following and 10 following))"""


@query("forward_risk", "LB5", f"with {q.BARS}, {RISK} select symbol, {q.D}, {q.rs(6, fwd_vol='fwd_vol', fwd_mdd='fwd_mdd', trail_vol='trail_vol')} from risk")
def forward_risk(spark, sf):
    return rnd(lb.forward_risk(derive.bars(spark, sf), 10).select("symbol", "date", "fwd_vol", "fwd_mdd", "trail_vol"))


@query("anchor_rows", "LB6", f"""with {q.BARS}, x as (select *, {q.lead('close', 5)} / close - 1 as fr, row_number() over (partition by symbol order by date desc) - 1 - 5 as k, row_number() over ({q.W}) as rn from bars)
  select symbol, {q.D}, {q.rs(6, close='close', fwd_ret='fr')} from x where k >= 0 and k % 5 = 0 and k / 5 < 120 and rn > 1""")
def anchor_rows(spark, sf):
    return rnd(lb.anchors(derive.bars(spark, sf), 5, max_anchors=120).select("symbol", "date", "close", "fwd_ret"))


@query("supervised_set", "LB7 SE1", f"""with {q.BARS}, x as (select *, close / {q.lag('close')} - 1 as ret_1, close / {q.avg('close', 20)} - 1 as ma_20_ratio, {q.lead('close', 5)} as f from bars), y as (select *, {q.sd('ret_1', 20)} as vol from x)
  select symbol, {q.D}, (f > close)::int as target, {q.rs(6, ret_1='ret_1', ma_20_ratio='ma_20_ratio', _fwd_ret='f / close - 1', _vol='vol')} from y where f is not null and ret_1 is not null and ma_20_ratio is not null""")
def supervised_set(spark, sf):
    return rnd(lb.supervised(ti.base_features(derive.bars(spark, sf)), ["ret_1", "ma_20_ratio"], 5))


@query("window_dataset", "LB8 PRJ17", f"""with {q.BARS}, x as (select symbol, date, list(close) over w as c, avg(close) over w as m, stddev_pop(close) over w + 1e-5 as s, list(close) over ({q.W} rows between 1 following and 5 following) as y,
    count(*) over ({q.W} rows between 1 following and 5 following) as ny from bars window w as ({q.W} rows between 29 preceding and current row))
  select symbol, {q.D}, {q.rs(6, first='greatest(-5.0, least(5.0, (c[1] - m) / s))', last='greatest(-5.0, least(5.0, (c[30] - m) / s))', total='list_sum(list_transform(c, lambda v: greatest(-5.0, least(5.0, (v - m) / s))))', target='y[5] / c[30]')} from x where len(c) = 30 and ny = 5""")
def window_dataset(spark, sf):
    d = lb.windows_dataset(derive.bars(spark, sf), ["close", "volume"], 30, 5)
    return rnd(d.join(derive.bars(spark, sf).select("symbol", "date", "close"), ["symbol", "date"]).select(
        "symbol", "date", F.get("close_seq", F.lit(0)).alias("first"), F.get("close_seq", F.lit(29)).alias("last"),
        F.aggregate("close_seq", F.lit(0.0), lambda a, x: a + x).alias("total"), (F.get("target_path", F.lit(4)) / F.col("close")).alias("target")))


XS = f"x0 as (select symbol, date, close / {q.lag('close')} - 1 as ret_1, close / {q.lag('close', 20)} - 1 as mom_20 from bars)"


def _pr(c):
    return (f"case when {c} is not null then (rank() over (partition by date order by {c} nulls last) + (count(*) over (partition by date, {c}) - 1) / 2.0) / count({c}) over (partition by date) end")


@query("cross_section", "XS1", f"with {q.BARS}, {XS}, y as (select *, {_pr('ret_1')} as a, {_pr('mom_20')} as b, ret_1 - avg(ret_1) over (partition by date) as e, stddev_samp(ret_1) over (partition by date) as s from x0) select symbol, {q.D}, {q.rs(6, xsec_ret_rank='a', xsec_mom_rank='b', xsec_excess='e', xsec_dispersion='s')} from y")
def cross_section(spark, sf):
    return rnd(lb.cross_section(derive.bars(spark, sf)).select("symbol", "date", "xsec_ret_rank", "xsec_mom_rank", "xsec_excess", "xsec_dispersion"))


MARKET = f"""mk0 as (select date, avg(r) as market_ret, count(r) as n from (select date, close / {q.lag('close')} - 1 as r from bars) where r is not null group by 1),
  market as (select date, market_ret, n, sum(ln(1 + market_ret)) over (order by date rows between unbounded preceding and current row) as log_price from mk0)"""


def market(spark, sf):
    s = Series()
    return ag.market_series(derive.bars(spark, sf).select("date", s.pct("close").alias("ret")))


@query("market_series", "AG2", f"with {q.BARS}, {MARKET} select {q.D}, n, {q.r('market_ret', 6, 'market_ret')}, {q.r('log_price', 6, 'log_price')} from market")
def market_series(spark, sf):
    return rnd(market(spark, sf).select("date", "n", "market_ret", "log_price"))


REGIME = MARKET + """, rg0 as (select date, ln(1 + market_ret) as log_ret from market),
  regime as (select *, case when s > 0.02 then 'bull' when s < -0.02 then 'bear' else 'range' end as regime from (select *, coalesce(sum(log_ret) over (order by date rows between 19 preceding and current row), 0.0) as s from rg0))"""


def regimes(spark, sf):
    m = market(spark, sf).withColumn("pool", F.lit("all"))
    return lb.rule_regime(lb.regime_observations(m, keys=("pool",), ret="market_ret"), keys=("pool",))


@query("rule_regimes", "XS2 XS3 XS5", f"with {q.BARS}, {REGIME} select {q.D}, regime, case when regime = 'bull' then 1.0::double else 0.0 end as regime_bull, case when regime = 'range' then 1.0::double else 0.0 end as regime_range, case when regime = 'bear' then 1.0::double else 0.0 end as regime_bear, {q.rs(6, log_ret='log_ret', vol=q.avg('log_ret', 20, w='order by date', f='stddev_pop'))} from regime")
def rule_regimes(spark, sf):
    return rnd(lb.regime_onehot(regimes(spark, sf)).select("date", "regime", "regime_bull", "regime_range", "regime_bear", "log_ret", "vol"))


@query("market_residuals", "XS6", f"""with {q.BARS}, r as (select symbol, date, close / {q.lag('close')} - 1 as ret from bars), r1 as (select * from r where ret is not null), j as (select r1.*, avg(ret) over (partition by date) as m from r1),
  f as (select symbol, regr_slope(ret, m) as beta, regr_intercept(ret, m) as alpha from j group by 1) select symbol, {q.D}, {q.rs(6, residual='ret - alpha - beta * m', beta='beta', alpha='alpha')} from j join f using (symbol)""")
def market_residuals(spark, sf):
    s = Series()
    r = derive.bars(spark, sf).select("symbol", "date", s.pct("close").alias("ret")).filter("ret is not null")
    return rnd(lb.market_residuals(r).select("symbol", "date", "residual", "beta", "alpha"))
