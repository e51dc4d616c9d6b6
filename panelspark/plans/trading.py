"""Feed, signal and gate queries (FEED*, SG*, SRC15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import indicators as ti
from panelspark.operators import trading as tr
from panelspark.operators.windows import Series, rnd
from panelspark.plans import sqltext as q
from panelspark.plans.indicators import T0, recursive_sql
from panelspark.plans.joins import VERIFIED, verified
from panelspark.plans.registry import query
from panelspark.plans.statistics import GATE, SC, gate
from panelspark.sources import derive

WT = "case horizon when 5 then 0.5::double when 10 then 0.3::double when 20 then 0.2::double end"
# drop the 10-row horizon on every third day so coverage varies
PH = q.SCORES + ", ph as (select symbol, date, close, horizon, case horizon when 5 then p_up else least(1.0, greatest(0.0, 0.5 + coalesce(fwd_ret, 0))) end as p_up from scores where not (horizon = 10 and day(date) % 3 = 0))"


def preds(spark, sf):
    s = derive.scores(derive.bars(spark, sf)).filter(~((F.col("horizon") == 10) & (F.dayofmonth("date") % 3 == 0)))
    p = F.when(F.col("horizon") == 5, F.col("p_up")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.coalesce("fwd_ret", F.lit(0.0)))))
    return s.select("symbol", "date", "close", "horizon", p.alias("p_up"))


AGG = f"ah as (select symbol, date, sum({WT} * p_up) / sum({WT}) as p, sum({WT}) as cov, case when bool_or(horizon = 10) then '' else '10' end as missing from ph group by 1, 2)"
_adv = "case when 2 * abs(p - 0.5) < 0.2 then 'withhold' when p > 0.5 then 'bullish' else 'bearish' end"


@query("horizon_blend", "FEED1 FEED2", f"with {PH}, {AGG} select symbol, {q.D}, missing, {q.rs(6, p_up='p', coverage='cov')}, {_adv} as advice from ah")
def horizon_blend(spark, sf):
    return rnd(tr.aggregate_horizons(preds(spark, sf)).withColumn("advice", tr.advisory()))


_pf = f"{PH}, {AGG}"
_vtail = VERIFIED[len(q.PREDICTIONS):]
FEED = q.PREDICTIONS + PH[len(q.SCORES):] + ", " + AGG + _vtail + ", au as (select symbol, avg(hit::int) as hr, sum(verified::int) as n from verified where verified group by 1)"


@query("decision_feed", "FEED3", f"with {FEED} select symbol, {q.D}, missing, {q.rs(6, p_up='p', coverage='cov', calibrated='0.25 + 0.5 * p', confidence='2 * abs(0.5 * p - 0.25)', audit_hit_rate='hr')}, n as audit_n, case when 2 * abs(0.5 * p - 0.25) < 0.2 then 'withhold' when p > 0.5 then 'bullish' else 'bearish' end as advice from ah left join au using (symbol)")
def decision_feed(spark, sf):
    v = verified(spark, sf).filter("verified").groupBy("symbol").agg(F.avg(F.col("hit").cast("int")).alias("hit_rate"), F.sum(F.col("verified").cast("int")).alias("verified"))
    return rnd(tr.decision_feed(preds(spark, sf), v, calibrate=0.25 + 0.5 * F.col("p_up")))


@query("portfolio_summary", "FEED4 SO3", f"with {PH} select symbol, {q.rs(6, **{f'p_up_{h}': f'arg_max(p_up, date) filter (where horizon = {h})' for h in (5, 10, 20)})} from ph group by 1")
def portfolio_summary(spark, sf):
    return rnd(tr.portfolio_summary(preds(spark, sf), [5, 10, 20]))


SIG = f"""s0 as (select symbol, date, any_value(close) as close, greatest(-1.0, least(1.0, sum(2 * (p_up - 0.5) * {WT}))) as s, sum(abs(2 * (p_up - 0.5)) * {WT}) / sum({WT}) as conf, sum((p_up > 0.5)::int) as np, sum((p_up < 0.5)::int) as nn from ph group by 1, 2),
  sig as (select *, case when s >= 0.1 then 'BUY' when s <= -0.1 then 'SELL' else 'HOLD' end as action, case when np > nn then 'up' when nn > np then 'down' when s > 0 then 'lean_up' when s < 0 then 'lean_down' else 'neutral' end as consensus from s0)"""


def signals(spark, sf):
    p = preds(spark, sf)
    s = tr.build_signal(p, buy=0.1, sell=-0.1)
    return s.join(derive.bars(spark, sf).select("symbol", "date", "close"), ["symbol", "date"])


@query("trade_signals", "SG1", f"with {PH}, {SIG} select symbol, {q.D}, action, consensus, {q.rs(6, score='s', strength='abs(s)', confidence='conf', close='close')} from sig")
def trade_signals(spark, sf):
    return rnd(signals(spark, sf))


BUD = SIG + """, bd0 as (select *, case when action <> 'HOLD' then greatest(0.0, least(0.2, 0.1 * (0.5 + least(abs(s), 1) * 0.5) * (0.5 + least(conf, 1) * 0.5))) else 0.0 end as pct, case when action = 'BUY' then 1 else -1 end as sd from sig),
  bd as (select *, case when action <> 'HOLD' then case when pct > 0 then greatest(floor(pct * 1000000.0 / close), 1)::bigint else 0 end end as qty, case when action <> 'HOLD' then close * (1 - sd * 0.03) end as sp, case when action <> 'HOLD' then close * (1 + sd * 0.06) end as tp from bd0)"""


@query("position_sizing", "SG2", f"with {PH}, {BUD} select symbol, {q.D}, action, qty, {q.rs(5, position_pct='pct', position_amount='pct * 1000000.0', stop_price='sp', take_price='tp')} from bd")
def position_sizing(spark, sf):
    b = tr.size_positions(signals(spark, sf))
    return rnd(b.select("symbol", "date", "action", "qty", "position_pct", "position_amount", "stop_price", "take_price"), 5)


@query("kelly_sizing", "SG2", f"with {PH}, {SIG}, k as (select symbol, date, action, greatest(0.5, least(0.95, conf)) as p from sig) select symbol, {q.D}, {q.r('case when action <> ' + chr(39) + 'HOLD' + chr(39) + ' then greatest(0.0, least(0.25, (p * 2 - (1 - p)) / 2)) else 0.0 end', 6, 'position_pct')} from k")
def kelly_sizing(spark, sf):
    return rnd(tr.size_positions(signals(spark, sf), method="kelly").select("symbol", "date", "position_pct"))


ADV = f"""{T0}, k0 as (select symbol, rn, date, tr from t1), {recursive_sql('k0', [('atr', repr(1 / 14), 'b.tr', 'tr')], 'b.date')},
  lv as (select symbol, date, case when count(close) over w >= 20 then min(low) over w end as sup, case when count(close) over w >= 20 then max(high) over w end as res, row_number() over ({q.W}) as n from bars window w as ({q.W} rows between 20 preceding and 1 preceding)),
  st0 as (select bd.symbol, bd.date, action, close as e, atr as a, sup, res, n, pct, action = 'BUY' as lg from bd join rec using (symbol, date) join lv using (symbol, date)),
  st1 as (select *, case when action = 'HOLD' then 'withheld' when n < 30 or e <= 0 or a is null or a <= 0 or sup is null or res is null or sup <= 0 then 'unavailable' else 'ok' end as status from st0),
  st2 as (select *, case when lg then sup * 0.995 else res * 1.005 end as sc, case when lg then e - 2 * a else e + 2 * a end as ab from st1),
  st3 as (select *, case when status = 'ok' then greatest(0.01, least(0.10, abs(e - case when lg then least(sc, ab) else greatest(sc, ab) end) / e)) end as sp, case when status = 'ok' then case when (lg and sc <= ab) or (not lg and sc >= ab) then 'structure' else 'atr' end end as basis from st2),
  st4 as (select *, case when lg then e * (1 + 1.5 * sp) else e * (1 - 1.5 * sp) end as rt, case when lg then case when res > e then res * 1.005 end else case when sup < e then sup * 0.995 end end as cap from st3),
  adv as (select *, case when status = 'ok' then case when lg then least(rt, coalesce(cap, rt)) else greatest(rt, coalesce(cap, rt)) end end as tk from st4)"""


@query("stop_take_advice", "SG3 TI40 TI27", f"with recursive {PH}, {BUD}, {ADV} select symbol, {q.D}, status, basis as stop_basis, {q.rs(4, suggested_stop='case when lg then e * (1 - sp) else e * (1 + sp) end', suggested_take='tk', stop_pct='sp', take_pct='abs(tk - e) / e', risk_reward='abs(tk - e) / e / sp', vol_scaled_position='case when status = ' + chr(39) + 'ok' + chr(39) + ' then pct * least(0.02 / (a / e), 1.0) end')} from adv")
def stop_take_advice(spark, sf):
    b = derive.bars(spark, sf)
    s = Series()
    lv = ti.support_resistance(ti.wilder_atr(b)).withColumn("bars", s.row()).select("symbol", "date", "atr", "support", "resistance", "bars")
    state = tr.size_positions(signals(spark, sf)).join(lv, ["symbol", "date"])
    return rnd(tr.advise(state).select("symbol", "date", "status", "stop_basis", "suggested_stop", "suggested_take", "stop_pct", "take_pct", "risk_reward", "vol_scaled_position"), 4)


@query("order_rows", "SG4 SRC15", f"""with {PH}, {BUD}, o as (select symbol, date, qty, 'main' as kind, case when action = 'BUY' then 'buy' else 'sell' end as side, null::double as price, 0 as reduce_only from bd where action <> 'HOLD' and qty > 0
   union all select symbol, date, qty, 'stop_loss', case when action = 'BUY' then 'sell' else 'buy' end, sp, 1 from bd where action <> 'HOLD' and qty > 0 union all select symbol, date, qty, 'take_profit', case when action = 'BUY' then 'sell' else 'buy' end, tp, 1 from bd where action <> 'HOLD' and qty > 0)
  select symbol, {q.D}, qty, kind, side, {q.r('price', 5, 'price')}, reduce_only from o""")
def order_rows(spark, sf):
    return rnd(tr.order_rows(tr.size_positions(signals(spark, sf))), 5)


_f = "concat_ws(',', case when samples < 30 then 'samples' end, case when abs(ic) < 0.02 then 'ic' end, case when hit_rate < 0.52 then 'hit_rate' end, case when windows < 3 then 'windows' end)"


@query("strategy_gate", "SG5 AG10 AG11", f"""with {SC}{', predictions as (' + q.PREDICTIONS.split('predictions as (')[1]}{_vtail}, {GATE}, gp as (select horizon, ({_f} = '')::int as passed from gate), a as (select count(*) as n, avg(hit::int) as hr from verified where verified),
  h as (select bool_and(passed = 1) as ok, string_agg(case when passed = 0 then cast(horizon as varchar) end, '|' order by horizon) as bad from gp)
  select (ok and n >= 30 and hr >= 0.5)::int as gated, concat_ws(',', case when bad is not null then 'horizons:' || bad end, case when n < 30 then 'audit_samples' end, case when hr < 0.5 then 'audit_hit_rate' end) as reasons from h, a""")
def strategy_gate(spark, sf):
    v = verified(spark, sf).filter("verified").agg(F.count(F.lit(1)).alias("verified"), F.avg(F.col("hit").cast("int")).alias("hit_rate"))
    return tr.strategy_gate(gate(spark, sf), v)


RC = f"""rs0 as (select symbol, max(date) as d, count(*) as n, sum((volume is null)::int) as nl from bad group by 1), rc as (select symbol, 'stale' as rule, case when date_diff('day', d, date '2001-11-01') > 50 then 2 when date_diff('day', d, date '2001-11-01') > 5 then 1 else 0 end as severity from rs0
   union all select symbol, 'history', case when n < 1600 then 2 when n < 3200 then 1 else 0 end from rs0 union all select symbol, 'nulls', case when nl > 0.5 * n then 2 when nl > 0 then 1 else 0 end from rs0)"""


def checks(spark, sf):
    b = derive.bad_bars(derive.bars(spark, sf))
    s = b.groupBy("symbol").agg(F.max("date").alias("last_date"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("volume").isNull().cast("int")).alias("nulls"))
    return tr.release_checks(s, "2001-11-01", min_rows=1600)


@query("release_checks", "SG6", f"with {q.BARS}, {q.BAD}, {RC} select symbol, rule, severity from rc")
def release_checks(spark, sf):
    return checks(spark, sf)


@query("alert_routing", "SG6", f"with {q.BARS}, {q.BAD}, {RC}, g as (select symbol, max(severity) as severity, coalesce(string_agg(case when severity > 0 then rule end, ',' order by rule), '') as rules from rc group by 1) select symbol, severity, rules, case severity when 2 then 'page' when 1 then 'digest' else 'none' end as channel from g")
def alert_routing(spark, sf):
    return tr.route_alerts(checks(spark, sf))


@query("pool_gates", "AG10 AG11", f"""with {SC}, p as (select *, case when cast(right(symbol, 1) as int) % 2 = 0 then 'even' else 'odd' end as pool from sc), i1 as ({q.spearman('p', 'pool, horizon', 'score', 'fwd_ret')}), i2 as ({q.spearman('p', 'horizon', 'score', 'fwd_ret')})
  select i1.pool, horizon, i1.n, {q.rs(6, ic='i1.ic', pooled_ic='i2.ic')}, case when abs(i1.ic) > abs(i2.ic) then 'stronger' else 'weaker' end as versus_pooled from i1 join i2 using (horizon)""")
def pool_gates(spark, sf):
    from panelspark.operators.order_stats import spearman
    from panelspark.plans.statistics import sc

    s = sc(spark, sf).withColumn("pool", F.when(F.right("symbol", F.lit(1)).cast("int") % 2 == 0, "even").otherwise("odd"))
    j = spearman(s, ["pool", "horizon"], "score", "fwd_ret").join(spearman(s, ["horizon"], "score", "fwd_ret", "pooled_ic").drop("n"), "horizon")
    return rnd(j.withColumn("versus_pooled", F.when(F.abs("ic") > F.abs("pooled_ic"), "stronger").otherwise("weaker")))
