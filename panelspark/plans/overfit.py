"""Drift and overfitting queries (ST19, ST20, ST23-ST26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import overfit as of
from panelspark.operators.windows import Series, rnd
from panelspark.plans import sqltext as q
from panelspark.plans.registry import query
from panelspark.plans.selection import RET, returns
from panelspark.sources import derive

DR = f"""dr0 as (select *, close / {q.lag('close')} - 1 as ret from bars), dr as (select symbol, feature, value, side from (unpivot (select symbol, ret, volume, (high - low) / close as spread, case when date < date '1998-06-01' then 'ref' else 'cur' end as side from dr0) on ret, volume, spread into name feature value value)),
  cuts as (select feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as c from dr where side = 'ref' group by 1), bb as (select dr.*, len(list_filter(c, lambda e: e <= value)) as bin from dr join cuts using (feature)),
  tt as (select feature, sum((side = 'ref')::int) as n_ref, sum((side = 'cur')::int) as n_cur from dr group by 1), pp as (select feature, n_ref, n_cur, bin, greatest(coalesce(r, 0)::double / n_ref, 1e-6) as pr, greatest(coalesce(c, 0)::double / n_cur, 1e-6) as pc from tt cross join range(0, 10) x(bin)
    left join (select feature, bin, sum((side = 'ref')::int) as r, sum((side = 'cur')::int) as c from bb group by 1, 2) using (feature, bin)), ps as (select feature, n_ref, n_cur, sum((pc - pr) * ln(pc / pr)) as psi from pp group by 1, 2, 3),
  kk as (select feature, max(abs(cr / nr - cc / nc)) as ks from (select feature, value, sum((side = 'ref')::int) over (partition by feature order by value)::double as cr, sum((side = 'cur')::int) over (partition by feature order by value)::double as cc,
     sum((side = 'ref')::int) over (partition by feature)::double as nr, sum((side = 'cur')::int) over (partition by feature)::double as nc from dr) group by 1)"""


def drift_panel(spark, sf):
    s = Series()
    b = derive.bars(spark, sf).select("symbol", "date", s.pct("close").alias("ret"), "volume", ((F.col("high") - F.col("low")) / F.col("close")).alias("spread"))
    side = F.when(F.col("date") < F.lit("1998-06-01").cast("date"), "ref").otherwise("cur").alias("side")
    return b.select("symbol", "date", side, "ret", "volume", "spread").unpivot(["symbol", "date", "side"], ["ret", "volume", "spread"], "feature", "value").filter("value is not null")


@query("drift_report", "ST19", f"with {q.BARS}, {DR} select feature, n_ref, n_cur, {q.rs(6, psi='psi', ks='ks')}, case when psi > 0.25 or ks > 0.25 then 'significant_drift' when psi > 0.1 then 'moderate_drift' else 'stable' end as verdict from ps join kk using (feature)")
def drift_report(spark, sf):
    return rnd(of.drift_report(drift_panel(spark, sf), ["feature"]))


@query("rolling_psi", "ST20", f"""with {q.BARS}, rp as (select 'v' as k, volume as value, floor((row_number() over (order by date, symbol) - 1) / 2000)::bigint as win from bars), f as (select win from rp group by 1 having count(*) = 2000), c as (select quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as c from rp where win = 0),
  b as (select win, len(list_filter(c, lambda e: e <= value)) as bin, count(*)::double / 2000 as p from rp, c where win in (select win from f) group by 1, 2), g as (select f.win, x.bin, greatest(coalesce(b.p, 0), 1e-6) as pc, greatest(coalesce(r.p, 0), 1e-6) as pr from f cross join range(0, 10) x(bin) left join b on b.win = f.win and b.bin = x.bin left join b r on r.win = 0 and r.bin = x.bin where f.win > 0)
  select 'v' as pool, win, {q.r('sum((pc - pr) * ln(pc / pr))', 6, 'psi')} from g group by win""")
def rolling_psi(spark, sf):
    b = derive.bars(spark, sf).select(F.lit("v").alias("pool"), "date", "symbol", F.col("volume").alias("value"))
    return rnd(of.rolling_psi(b, ["pool"], ["date", "symbol"], 2000))


@query("drift_timeline_correlation", "ST20", None)
def drift_timeline_correlation(spark, sf):
    """Correlation of the rolling PSI with the rank correlation of the signal on the same row windows."""
    from panelspark.operators.statistics import windowed_ic
    from panelspark.operators.windows import pearson

    s = derive.scores(derive.bars(spark, sf), horizons=(5,)).filter("fwd_ret is not null").withColumns({"pool": F.lit("v"), "score": F.col("p_up")})
    p = of.rolling_psi(s.select("pool", "date", "symbol", F.col("p_up").alias("value")), ["pool"], ["date", "symbol"], 2000)
    ic = windowed_ic(s, ["pool"], ["date", "symbol"], 2000)
    return rnd(p.join(ic, ["pool", "win"]).groupBy("pool").agg(F.count(F.lit(1)).alias("windows"), pearson("psi", "ic").alias("rho")))


MOM = f"{RET}, mm as (select symbol, ret, avg(ret) over (partition by symbol) as m from ret0 where ret is not null), mo as (select symbol, count(*) as n, any_value(m) as m, stddev_samp(ret) as s, avg(power(ret - m, 3)) as m3, avg(power(ret - m, 4)) as m4 from mm group by 1)"


@query("return_moments", "ST23", f"with {q.BARS}, {MOM} select symbol, n, {q.rs(5, sr='m / s', skew='m3 / power(s, 3)', kurt='m4 / power(s, 4)')} from mo")
def return_moments(spark, sf):
    return rnd(of.moments(returns(spark, sf), ["symbol"]), 5)


@query("sharpe_inference", "ST23", None)
def sharpe_inference(spark, sf):
    return rnd(of.sharpe_inference(returns(spark, sf), ["symbol"], n_trials=44))


PB = f"""{RET}, pd as (select date, row_number() over (order by date) - 1 as d, count(*) over () as n from (select distinct date from ret0 where ret is not null)), bl as (select date, d // (n // 8) as block from pd), b as (select symbol, block, count(*) as n, sum(ret) as s, sum(ret * ret) as q from ret0 join bl using (date) where ret is not null and block < 8 group by 1, 2),
  mk as (select m from range(0, 256) t(m) where bit_count(m) = 4), h as (select m, symbol, (m >> block) & 1 as inside, sum(n) as n, sum(s) as s, sum(q) as q from mk, b group by all),
  sr as (select m, symbol, inside, case when sqrt(greatest(q / n - power(s / n, 2), 0)) > 1e-12 then s / n / sqrt(greatest(q / n - power(s / n, 2), 0)) else 0 end as sr from h),
  k as (select mk.m, symbol, coalesce(max(sr) filter (where inside = 1), 0) as a, coalesce(max(sr) filter (where inside = 0), 0) as o from mk cross join (select distinct symbol from b) left join sr using (m, symbol) group by all),
  champ as (select m, o from k qualify row_number() over (partition by m order by a desc, symbol) = 1), rk as (select champ.m, count(*) filter (where k.o < champ.o) as beaten, count(*) as t from k join champ using (m) group by 1)"""


@query("pbo_block_splits", "ST24", f"with {q.BARS}, {PB} select count(*) as splits, {q.rs(6, pbo='avg((beaten / (t - 1) < 0.5)::int)', mean_logit='avg(ln((beaten + 1) / (t - beaten)))')} from rk")
def pbo_block_splits(spark, sf):
    return rnd(of.pbo_cscv(returns(spark, sf), "symbol", "date", n_blocks=8))


@query("pbo_sixteen_blocks", "ST24", None)
def pbo_sixteen_blocks(spark, sf):
    return rnd(of.pbo_cscv(returns(spark, sf), "symbol", "date", n_blocks=16))


@query("pbo_paths", "ST25", f"""with {q.BARS}, {RET}, p as (select symbol as trial, month(date) as path, avg(case when day(date) <= 15 then ret end) as i, avg(case when day(date) > 15 then ret end) as o from ret0 where ret is not null group by 1, 2),
  g as (select path, median(o) as med, arg_max(o, i) as champ from p group by 1) select count(*) as paths, {q.r('avg((champ < med)::int)', 6, 'pbo')} from g""")
def pbo_paths(spark, sf):
    r, d = returns(spark, sf).filter("ret is not null"), F.dayofmonth("date")
    p = r.groupBy(F.col("symbol").alias("trial"), F.month("date").alias("path")).agg(F.avg(F.when(d <= 15, F.col("ret"))).alias("is_score"), F.avg(F.when(d > 15, F.col("ret"))).alias("oos_score"))
    return rnd(of.pbo_paths(p))


@query("deflated_shrinkage", "ST25", f"with {q.BARS}, {RET}, t as (select symbol, avg(ret) as s from ret0 group by 1) select count(s) as n_trials, {q.rs(6, best='max(s)', penalty='sqrt(2 * ln(count(s))) * stddev_samp(s)', deflated='max(s) - sqrt(2 * ln(count(s))) * stddev_samp(s)')} from t")
def deflated_shrinkage(spark, sf):
    return rnd(of.deflated_shrinkage(returns(spark, sf).groupBy("symbol").agg(F.avg("ret").alias("score"))))


@query("trial_budget", "ST26", f"select o_orderpriority as command, count(distinct o_orderstatus || '|' || o_custkey) as distinct_trials, {q.r('0.05 / count(distinct o_orderstatus || chr(124) || o_custkey)', 8, 'alpha_left')} from orders group by 1")
def trial_budget(spark, sf):
    o = derive.table(spark, sf, "orders")
    return rnd(of.trial_budget(o.select(F.col("o_orderpriority").alias("command"), F.concat_ws("|", "o_orderstatus", "o_custkey").alias("fingerprint"))), 8)
