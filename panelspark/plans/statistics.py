"""Panel statistics queries (ST1-ST18, ST27-ST34)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.scalar import two_sided_p
from panelspark.operators import statistics as st
from panelspark.operators.windows import Series, rnd
from panelspark.plans import sqltext as q
from panelspark.plans.labels import RISK
from panelspark.plans.registry import query
from panelspark.sources import derive

SC = q.SCORES + ", sc as (select *, 2 * (p_up - 0.5) as score from scores)"


def sc(spark, sf):
    return derive.scores(derive.bars(spark, sf)).withColumn("score", 2 * (F.col("p_up") - 0.5))


HR = "coalesce(avg(case when abs(score) > {b} and fwd_ret <> 0 then ((score > 0) = (fwd_ret > 0))::int end), 0.0)"


@query("hit_rates", "ST2 ST2b", f"with {SC} select symbol, horizon, count(*) as n, {q.rs(6, hit=HR.format(b=0), banded=HR.format(b=0.2), gate='avg(case when fwd_ret is not null then ((score > 0 and fwd_ret > 0) or (score < 0 and fwd_ret < 0))::int end)')} from sc group by 1, 2")
def hit_rates(spark, sf):
    g = sc(spark, sf).groupBy("symbol", "horizon")
    return rnd(g.agg(F.count(F.lit(1)).alias("n"), st.hit_rate().alias("hit"), st.hit_rate(band=0.2).alias("banded"), st.gate_hit_rate().alias("gate")))


@query("neutral_band", "ST3", f"""with {SC}, d as (select horizon, abs(score) as a, ((score > 0) = (fwd_ret > 0))::int as ok from sc where fwd_ret is not null and fwd_ret <> 0 and date < date '1999-01-01'),
  v as (select horizon, a, row_number() over (partition by horizon order by a) as k, count(*) over (partition by horizon) as m from (select distinct horizon, a from d)),
  b as (select distinct horizon, a as band from v, (values (0.1::double), (0.2::double), (0.3::double), (0.4::double), (0.5::double), (0.6::double), (0.7::double)) g(q) where k = least(floor(m * q) + 1, m) union select distinct horizon, 0.0 from d),
  t as (select horizon, count(*) as n from d group by 1), r as (select b.horizon, band, avg(ok) as hr, count(*) as kept from b join d on d.horizon = b.horizon and d.a > b.band group by 1, 2),
  k as (select r.*, row_number() over (partition by r.horizon order by hr desc, band) as k from r join t using (horizon) where kept >= greatest(floor(n * 0.5), 1)) select horizon, {q.rs(6, band='band', hit_rate='hr')}, kept from k where k = 1""")
def neutral_band(spark, sf):
    train = sc(spark, sf).filter(F.col("date") < F.lit("1999-01-01").cast("date"))
    return rnd(st.neutral_band(train, ["horizon"]))


WIN = f"""wi as (select *, floor((row_number() over (partition by horizon order by date, symbol) - 1) / 500) as win from sc where fwd_ret is not null), wic as (select * from ({q.spearman('wi', 'horizon, win', 'score', 'fwd_ret')}) where n = 500)"""


@query("windowed_ic", "ST4", f"with {SC}, {WIN} select horizon, count(*) as windows, {q.rs(6, mean_ic='avg(ic)', icir='case when stddev_pop(ic) > 1e-6 then avg(ic) / stddev_pop(ic) else 0 end')} from wic group by 1")
def windowed_ic(spark, sf):
    return rnd(st.icir(st.windowed_ic(sc(spark, sf), ["horizon"], ["date", "symbol"], 500), ["horizon"]))


GATE = f"""{WIN}, gi as ({q.spearman('sc', 'horizon', 'score', 'fwd_ret')}), gate as (select horizon, n as samples, ic, hr as hit_rate, w.windows, w.mean_ic, w.icir from gi join (select horizon, {HR.format(b=0)} as hr from sc where fwd_ret is not null group by 1) using (horizon)
   join (select horizon, count(*) as windows, avg(ic) as mean_ic, case when stddev_pop(ic) > 1e-6 then avg(ic) / stddev_pop(ic) else 0 end as icir from wic group by 1) w using (horizon))"""
_fail = "concat_ws(',', case when samples < 30 then 'samples' end, case when abs(ic) < 0.02 then 'ic' end, case when hit_rate < 0.52 then 'hit_rate' end, case when windows < 3 then 'windows' end)"


def gate(spark, sf):
    return st.horizon_gate(sc(spark, sf), ["horizon"], ["date", "symbol"], 500)


@query("horizon_gate", "ST5 ST15", f"with {SC}, {GATE} select horizon, samples, windows, {q.rs(6, ic='ic', hit_rate='hit_rate', mean_ic='mean_ic', icir='icir')}, ({_fail} = '')::int as passed, {_fail} as reason from gate")
def horizon_gate(spark, sf):
    return rnd(gate(spark, sf))


@query("gate_shortfall", "ST6", f"""with {SC}, {GATE}, x as (select horizon, 'ic' as metric, abs(ic) as value, 0.3::double as target from gate union all select horizon, 'hit_rate', hit_rate, 0.6::double from gate union all select horizon, 'windows', windows, 100.0::double from gate),
  y as (select *, greatest(0.0, (target - value) / target) as gap from x) select horizon, metric, {q.rs(6, value='value', target='target', gap='gap')}, (row_number() over (partition by horizon order by gap desc, metric) = 1 and gap > 0)::int as binding from y""")
def gate_shortfall(spark, sf):
    return rnd(st.gate_shortfall(gate(spark, sf), ["horizon"], {"ic": 0.3, "hit_rate": 0.6, "windows": 100}))


_IC = f"ic as ({q.spearman('sc', 'symbol, horizon', 'score', 'fwd_ret')})"


@query("ic_intervals", "ST7", f"with {SC}, {_IC} select symbol, horizon, n, {q.rs(6, ic='ic', low='tanh(atanh(ic) - 1.959963984540054 / sqrt(greatest(n - 3, 1)))', high='tanh(atanh(ic) + 1.959963984540054 / sqrt(greatest(n - 3, 1)))')} from ic where n >= 10")
def ic_intervals(spark, sf):
    from panelspark.operators.order_stats import spearman

    ic = spearman(sc(spark, sf), ["symbol", "horizon"], "score", "fwd_ret", bounded=True).withColumn("ci", st.fisher_interval())
    return rnd(ic.filter("n >= 10").select("symbol", "horizon", "n", "ic", "ci.low", "ci.high"))


QR = """qb as (select *, row_number() over (partition by horizon order by score, date, symbol) - 1 as k, count(*) over (partition by horizon) as nn from sc where fwd_ret is not null),
  qr as (select horizon, case when k < nn // 5 then 1 when k < 2 * nn // 5 then 2 when k < 3 * nn // 5 then 3 when k < 4 * nn // 5 then 4 else 5 end as quantile, count(*) as samples, avg(fwd_ret) as mean_return, """ + HR.format(b=0) + " as hit_rate from qb group by 1, 2)"


@query("quantile_returns", "ST8", f"with {SC}, {QR} select horizon, quantile, samples, {q.rs(6, mean_return='mean_return', hit_rate='hit_rate')} from qr")
def quantile_returns(spark, sf):
    return rnd(st.quantile_returns(sc(spark, sf), ["horizon"], ["date", "symbol"]))


SPREAD = f"spread as (select horizon, max(case when quantile = 5 then mean_return end) - max(case when quantile = 1 then mean_return end) as spread from qr group by 1)"
TURN = "tn as (select symbol, horizon, count(*) as samples, sum(case when abs(p) > 1e-12 and abs(score) > 1e-12 and (p > 0) <> (score > 0) then 1 else 0 end) as flips from (select *, lag(score) over (partition by symbol, horizon order by date) as p from sc) group by 1, 2)"


@query("signal_turnover", "ST9", f"with {SC}, {TURN} select symbol, horizon, samples, flips, {q.r('flips::double / nullif(samples - 1, 0)', 6, 'turnover')} from tn")
def signal_turnover(spark, sf):
    return rnd(st.turnover(sc(spark, sf), ["symbol", "horizon"], ["date"]))


@query("ic_decay", "ST10", f"""with {SC}, s1 as (select symbol, date, close, score from sc where horizon = 5), l as (select score, h as days, case h {' '.join(f"when {h} then (lead(close, {h}) over (partition by symbol, h order by date)) / close - 1" for h in (1, 3, 5, 10, 20, 40))} end as fwd_ret
   from s1, (values (1), (3), (5), (10), (20), (40)) t(h)) select days, n, {q.r('ic', 6, 'ic')} from ({q.spearman('l', 'days', 'score', 'fwd_ret')})""")
def ic_decay(spark, sf):
    s = derive.scores(derive.bars(spark, sf), horizons=(5,)).withColumn("score", 2 * (F.col("p_up") - 0.5))
    return rnd(st.horizon_decay(s, [1, 3, 5, 10, 20, 40]))


@query("cost_sensitivity", "ST11 ST12", f"""with {SC}, {QR}, {SPREAD}, {TURN}, x as (select horizon, spread, sum(flips)::double / sum(samples - 1) as turnover from spread join tn using (horizon) group by 1, 2),
  t(tier, one_side) as (values ('conservative', 0.00125::double), ('base', 0.00075::double), ('aggressive', 0.0003::double))
  select horizon, tier, days, {q.rs(7, spread='spread', turnover='turnover', cost='2 * one_side * turnover * days', net='spread - 2 * one_side * turnover * days')} from x, t, (values (5), (10), (20)) d(days)""")
def cost_sensitivity(spark, sf):
    s = sc(spark, sf)
    spread = st.quantile_spread(st.quantile_returns(s, ["horizon"], ["date", "symbol"]), ["horizon"])
    turn = st.turnover(s, ["symbol", "horizon"], ["date"]).groupBy("horizon").agg((F.sum("flips") / F.sum(F.col("samples") - 1)).alias("turnover"))
    x = st.cost_sensitivity(spread.join(turn, "horizon"), [5, 10, 20])
    return rnd(x.select("horizon", "tier", "days", "spread", "turnover", "cost", "net"), 7)


@query("factor_health", "ST12 ST8", f"""with {SC}, {QR}, {SPREAD}, m as ({q.spearman('qr', 'horizon', 'quantile', 'mean_return', 'monotonic_ic')}), g as ({q.spearman('sc', 'horizon', 'score', 'fwd_ret')})
  select horizon, g.n, {q.rs(6, ic='ic', spread='spread', monotonic_ic='monotonic_ic')} from g join spread using (horizon) join (select horizon, monotonic_ic from m) using (horizon)""")
def factor_health(spark, sf):
    from panelspark.operators.order_stats import spearman

    s = sc(spark, sf)
    return rnd(spearman(s, ["horizon"], "score", "fwd_ret").join(st.quantile_spread(st.quantile_returns(s, ["horizon"], ["date", "symbol"]), ["horizon"]), "horizon"))


TREND = f"""tp as (select *, row_number() over (partition by horizon order by date, symbol) as pos, count(*) over (partition by horizon) as nn from sc where fwd_ret is not null),
  ta as (select horizon, a as anchor, score, fwd_ret from tp, range(0, 100000) t(a) where a >= greatest(0, ceil((pos - 2000) / 1000.0)) and a <= floor((pos - 1) / 1000) and a * 1000 + 2000 <= nn),
  tic as ({q.spearman('ta', 'horizon, anchor', 'score', 'fwd_ret')}), tg as (select horizon, count(*) as anchors, arg_max(ic, anchor) as last_ic, regr_slope(ic, anchor) as slope, power(corr(ic, anchor), 2) as r2 from tic group by 1)"""


@query("ic_trend", "ST13", f"""with {SC}, {TREND.replace('range(0, 100000)', 'range(0, 1000)')} select horizon, anchors, {q.rs(6, last_ic='last_ic', slope='slope', r2='r2', steps_to_floor='case when slope < 0 and last_ic > 0.02 then (last_ic - 0.02) / -slope end')},
  case when anchors < 3 then 'insufficient' when last_ic <= 0.02 then 'breached' when slope < 0 and r2 > 0.3 then 'declining' else 'stable' end as status from tg""")
def ic_trend(spark, sf):
    return rnd(st.ic_trend(sc(spark, sf), ["horizon"], ["date", "symbol"], 2000, 1000))


@query("holm_adjustment", "ST14 ST15", f"""with {SC}, {_IC}, p as (select *, exp(-abs(ic) * sqrt(n - 1)) as p from ic), k as (select *, count(*) over (partition by horizon) as m, row_number() over (partition by horizon order by p, symbol) as k from p)
  select symbol, horizon, {q.rs(6, p='p', p_bonferroni='least(1.0, p * m)', p_holm='max(least(1.0, p * (m - k + 1))) over (partition by horizon order by p, symbol rows between unbounded preceding and current row)')} from k""")
def holm_adjustment(spark, sf):
    from panelspark.operators.order_stats import spearman

    ic = spearman(sc(spark, sf), ["symbol", "horizon"], "score", "fwd_ret", bounded=True)
    t = ic.select("symbol", "horizon", F.exp(-F.abs("ic") * F.sqrt(F.col("n") - 1)).alias("p"))
    return rnd(st.multiple_testing(t, "p", ["horizon"], ["symbol"]))


@query("horizon_scan", "ST14 ST15 ST26", None)
def horizon_scan(spark, sf):
    """Gate rows of every horizon with approximate p values and Holm adjustment over the candidates."""
    g = gate(spark, sf).withColumn("p", st.ic_p_value("ic", "samples"))
    return rnd(st.multiple_testing(g, "p", key=["horizon"]).withColumn("coverage", F.col("samples") / F.max("samples").over(_all())), 8)


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


RS = f"{RISK}, rs as (select r.*, abs(close / {q.avg('close', 20)} - 1) as sig from risk r), rr as (select * from rs where fwd_vol is not null and trail_vol is not null and sig is not null)"


def _rk(a, b):
    return f"corr(r{a}, r{b})"


_ranks = ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as r{k}" for k, c in (("x", "sig"), ("y", "fwd_vol"), ("z", "trail_vol")))


def risk_panel(spark, sf):
    from panelspark.operators.labels import forward_risk

    s = Series()
    r = forward_risk(derive.bars(spark, sf), 10).withColumn("sig", F.abs(F.col("close") / s.mean("close", 20) - 1))
    return r.withColumn("pool", F.lit("all"))


@query("risk_informativeness", "ST16 ST17", f"""with {q.BARS}, {RS}, k as (select {_ranks} from rr), c as (select count(*) as n, {_rk('x', 'y')} as a, {_rk('x', 'z')} as b, {_rk('y', 'z')} as c from k), p as (select *, (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) as pic from c)
  select 'all' as pool, n, {q.rs(6, rxy='a', rxz='b', ryz='c', partial_ic='pic', t='pic * sqrt((floor(n / 10) - 2) / (1 - pic * pic))')}, floor(n / 10)::bigint as n_eff, (abs(pic * sqrt((floor(n / 10) - 2) / (1 - pic * pic))) >= 2 and abs(pic) >= 0.1)::int as increment from p""")
def risk_informativeness(spark, sf):
    return rnd(st.partial_spearman(risk_panel(spark, sf), ["pool"], "sig", "fwd_vol", "trail_vol", h=10))


@query("confidence_diagnostics", "ST18", f"""with {SC}, c as (select horizon, abs(score) as conf, abs(fwd_ret) as mag, fwd_ret as ret from sc where fwd_ret is not null), a as ({q.spearman('c', 'horizon', 'conf', 'ret')}), b as ({q.spearman('c', 'horizon', 'conf', 'mag', 'ic_vol')})
  select horizon, a.n, {q.rs(6, ic_return='ic', ic_vol='ic_vol')} from a join (select horizon, ic_vol from b) using (horizon)""")
def confidence_diagnostics(spark, sf):
    from panelspark.operators.order_stats import spearman

    c = sc(spark, sf).filter("fwd_ret is not null").select("horizon", F.abs("score").alias("conf"), F.abs("fwd_ret").alias("mag"), "fwd_ret")
    return rnd(spearman(c, ["horizon"], "conf", "fwd_ret", "ic_return").join(spearman(c, ["horizon"], "conf", "mag", "ic_vol").drop("n"), "horizon"))


FEE = 0.00125
TM = f"""tm0 as (select *, (fwd_ret > 0)::int as y, (p_up > 0.5)::int as h, case when p_up > 0.5 then fwd_ret else -fwd_ret end - 2 * {FEE}::double as net from scores where fwd_ret is not null),
  tm1 as (select *, sum(net) over (partition by symbol, horizon order by date) as cum from tm0), tm2 as (select *, cum - max(cum) over (partition by symbol, horizon order by date) as dd from tm1),
  tm as (select symbol, horizon, count(*) as n, avg((h = y)::int) as acc, sum(h * y)::double / nullif(sum(h), 0) as pr, sum(h * y)::double / nullif(sum(y), 0) as rc,
   coalesce(avg(net) / nullif(stddev_pop(net), 0) * sqrt(252.0 / horizon), 0) as sharpe, min(dd) as mdd, coalesce(sum(greatest(net, 0)) / nullif(sum(greatest(-net, 0)), 0), 999.0) as pf,
   sum(greatest(-net, 0)) <= 0 as capped, sum(net) as total, avg((net > 0)::int) as wins from tm2 group by 1, 2)"""


@query("trading_metrics", "ST27 RM12", f"with {q.SCORES}, {TM} select symbol, horizon, n, capped as profit_factor_is_capped, {q.rs(6, accuracy='acc', precision='coalesce(pr, 0)', recall='coalesce(rc, 0)', f1='coalesce(2 * pr * rc / nullif(pr + rc, 0), 0)', sharpe='sharpe', max_drawdown='mdd', profit_factor='pf', total_return='total', win_rate='wins')} from tm")
def trading_metrics(spark, sf):
    d = derive.scores(derive.bars(spark, sf)).filter("fwd_ret is not null").withColumn("y", (F.col("fwd_ret") > 0).cast("int"))
    return rnd(st.trading_metrics(d, ["symbol", "horizon"], ["date"], horizon="horizon", fee=FEE))


@query("auc", "ST28", f"""with {q.SCORES}, d as (select horizon, p_up, (fwd_ret > 0)::int as y from scores where fwd_ret is not null), r as (select *, rank() over (partition by horizon order by p_up) + (count(*) over (partition by horizon, p_up) - 1) / 2.0 as rk from d)
  select horizon, count(*) as n, sum(y)::bigint as pos, {q.r('(sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::double * (count(*) - sum(y)))', 6, 'auc')} from r group by 1""")
def auc(spark, sf):
    d = derive.scores(derive.bars(spark, sf)).filter("fwd_ret is not null").withColumn("y", (F.col("fwd_ret") > 0).cast("int"))
    return rnd(st.auc(d, ["horizon"]))


ARMS = """arms as (select horizon as arm, date, avg(case when p_up > 0.5 then fwd_ret end) as ret from scores where fwd_ret is not null group by 1, 2)"""


def arms(spark, sf):
    d = derive.scores(derive.bars(spark, sf)).filter("fwd_ret is not null")
    return d.groupBy(F.col("horizon").alias("arm"), "date").agg(F.avg(F.when(F.col("p_up") > 0.5, F.col("fwd_ret"))).alias("ret")).filter("ret is not null")


@query("paired_arms", "ST29 ST30", f"""with {q.SCORES}, {ARMS}, d as (select a.arm, a.ret - b.ret as d from arms a join arms b on a.date = b.date and b.arm = 5 where a.arm <> 5 and a.ret is not null and b.ret is not null),
  t as (select arm, count(*) as n, avg(d) as m, avg(d) * sqrt(count(*)) / stddev_samp(d) as t from d group by 1) select arm, n, {q.rs(6, mean_delta='m', t='t')}, case when n < 8 then 'defer' when t >= 2 then 'adopt' when t <= -2 then 'reject' else 'defer' end as verdict from t""")
def paired_arms(spark, sf):
    return rnd(st.paired_vs_baseline(arms(spark, sf), 5, ["date"]).select("arm", "n", "mean_delta", "t", "verdict"))


@query("hit_rate_tests", "ST29 ST31", f"""with {SC}, g as (select symbol, horizon, count(*) as n, {HR.format(b=0)} as hr from sc where fwd_ret is not null group by 1, 2), b as (select symbol, hr as base from g where horizon = 5)
  select symbol, horizon, n, {q.rs(6, hit_rate='hr', z='(hr - 0.5) / sqrt(0.25 / n)')}, case when hr - base > 0.02 then 'improved' when hr - base < -0.02 then 'degraded' else 'unchanged' end as verdict from g join b using (symbol)""")
def hit_rate_tests(spark, sf):
    g = sc(spark, sf).filter("fwd_ret is not null").groupBy("symbol", "horizon").agg(F.count(F.lit(1)).alias("n"), st.hit_rate().alias("hit_rate"))
    b = g.filter("horizon = 5").select("symbol", F.col("hit_rate").alias("base"))
    j = g.join(b, "symbol").withColumns({"z": st.hit_rate_z(F.col("hit_rate"), F.col("n")), "verdict": st.increment_verdict(F.col("hit_rate"), F.col("base"), 0.02)})
    return rnd(j.drop("base"))


@query("source_contrast", "ST32", f"""with {SC}, w as (select symbol, date, max(case when horizon = 5 then score end) as a, max(case when horizon = 10 then fwd_ret end) as b, max(case when horizon = 5 then fwd_ret end) as fwd_ret from sc group by 1, 2), x as (select *, floor(least(abs(a), 0.999) * 5) as band from w where fwd_ret is not null and b is not null),
  bm as (select band, count(*) as samples, avg(fwd_ret) as mean_return from x group by 1), i as ({q.spearman('x', '', 'a', 'b', 'source_ic')}), m as ({q.spearman('bm', '', 'band', 'mean_return', 'band_ic')})
  select band::bigint as band, samples, {q.rs(6, mean_return='mean_return', source_ic='source_ic', band_ic='band_ic')}, (abs(band_ic) >= 0.8)::int as monotonic from bm, (select source_ic from i), (select band_ic from m)""")
def source_contrast(spark, sf):
    from panelspark.operators.order_stats import spearman

    s = sc(spark, sf)
    x = s.filter("horizon = 5").select("symbol", "date", F.col("score").alias("a"), "fwd_ret").join(
        s.filter("horizon = 10").select("symbol", "date", F.col("fwd_ret").alias("b")), ["symbol", "date"]).filter("fwd_ret is not null and b is not null")
    bands = x.withColumn("band", F.floor(F.least(F.abs("a"), F.lit(0.999)) * 5)).groupBy("band").agg(F.count(F.lit(1)).alias("samples"), F.avg("fwd_ret").alias("mean_return"))
    ic, mono = spearman(x, [], "a", "b", "source_ic").drop("n"), spearman(bands, [], "band", "mean_return", "band_ic").drop("n")
    j = bands.join(F.broadcast(ic)).join(F.broadcast(mono))  # one row each
    return rnd(j.withColumn("monotonic", (F.abs("band_ic") >= 0.8).cast("int")))


@query("evidence_weights", "ST33", f"with {SC}, {GATE}, e as (select horizon, abs(ic) * greatest(hit_rate - 0.5, 0) as e from gate) select horizon, {q.r('case when sum(e) over () > 0 then e / sum(e) over () else 1.0 / count(*) over () end', 6, 'weight')} from e")
def evidence_weights(spark, sf):
    return rnd(st.evidence_weights(gate(spark, sf)).select("horizon", "weight"))


@query("weight_comparison", "ST34", f"""with {SC}, w as (select symbol, date, max(case when horizon = 5 then fwd_ret end) as h5, max(case when horizon = 10 then fwd_ret end) as h10, max(case when horizon = 20 then score end) as sc, max(case when horizon = 20 then fwd_ret end) as fwd_ret from sc group by 1, 2),
  x as (select 'even' as plan, 0.5 * h5 + 0.5 * h10 as score, fwd_ret from w where h5 is not null and h10 is not null and fwd_ret is not null union all select 'tilted', 0.2 * h5 + 0.8 * h10, fwd_ret from w where h5 is not null and h10 is not null and fwd_ret is not null)
  select plan, n, {q.rs(6, ic='ic', hit_rate='hr')} from ({q.spearman('x', 'plan', 'score', 'fwd_ret')}) join (select plan, {HR.format(b=0)} as hr from x group by 1) using (plan)""")
def weight_comparison(spark, sf):
    from panelspark.operators.joins import align_horizons

    s = sc(spark, sf)
    w = align_horizons(s, [5, 10, 20], "fwd_ret")
    return rnd(st.weight_comparison(w, {"even": {"fwd_ret_5": 0.5, "fwd_ret_10": 0.5}, "tilted": {"fwd_ret_5": 0.2, "fwd_ret_10": 0.8}}, "fwd_ret_20"))
