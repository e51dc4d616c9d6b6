"""Calibration and conformal queries (CA*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import calibration as ca
from panelspark.operators import isotonic
from panelspark.operators.aggregates import threshold_scan
from panelspark.operators.windows import rnd
from panelspark.plans import sqltext as q
from panelspark.plans.aggregates import SAMPLES, samples
from panelspark.plans.registry import query
from panelspark.sources import derive

Y = q.SCORES + ", yy as (select *, (fwd_ret > 0)::int as y, least(floor(p_up * 10), 9)::int as bin from scores where fwd_ret is not null)"
CUT = "1999-01-01"


def labelled(spark, sf):
    return derive.scores(derive.bars(spark, sf)).filter("fwd_ret is not null").withColumn("y", (F.col("fwd_ret") > 0).cast("int"))


@query("reliability_curve", "CA1 CA2", f"with {Y}, g as (select horizon, bin, count(*) as n, avg(p_up) as p, avg(y) as o from yy group by 1, 2) select horizon, bin, n, {q.rs(6, mean_p='p', observed='o', gap='abs(p - o)')}, (n >= 30)::int as available from g")
def reliability_curve(spark, sf):
    return rnd(ca.reliability(labelled(spark, sf), ["horizon"], min_samples=30))


@query("calibration_errors", "CA1", f"with {Y}, g as (select horizon, bin, count(*) as n, abs(avg(p_up) - avg(y)) as gap from yy group by 1, 2), e as (select horizon, sum(n * gap) / sum(n) as ece from g group by 1), b as (select horizon, count(*) as n, avg(power(p_up - y, 2)) as brier from yy group by 1) select horizon, n, {q.rs(6, brier='brier', ece='ece')} from b join e using (horizon)")
def calibration_errors(spark, sf):
    return rnd(ca.calibration_errors(labelled(spark, sf), ["horizon"]))


@query("calibration_legs", "CA3 CA5", None)
def calibration_legs(spark, sf):
    """Every horizon: raw, logistic and isotonic scores on the dates after those of the fit."""
    d = labelled(spark, sf)
    cut = F.lit(CUT).cast("date")
    return rnd(isotonic.calibrate_and_evaluate(d.filter(F.col("date") < cut), d.filter(F.col("date") >= cut), ["horizon"]), 8)


_steps = f"""{Y}, gr as (select *, floor(p_up * 1000) / 1000 as x from yy), c0 as (select horizon, x, sum(y) as s, count(*) as n from gr where date < date '{CUT}' group by 1, 2),
  c as (select *, row_number() over w as i, sum(s) over w as cs, sum(n) over w as cn from c0 window w as (partition by horizon order by x)),
  av as (select a.horizon, a.i as i, b.i as j, (b.cs - a.cs + a.s)::double / (b.cn - a.cn + a.n) as m from c a join c b on a.horizon = b.horizon and a.i <= b.i),
  mn as (select horizon, i, j, min(m) over (partition by horizon, i order by j desc rows between unbounded preceding and current row) as m from av), iso as (select horizon, j as i, max(m) as v from mn group by 1, 2),
  th as (select horizon, x, v, lead(x) over w as x1, lead(v) over w as v1 from c join iso using (horizon, i) window w as (partition by horizon order by x)),
  lo as (select horizon, min(x) as x0, arg_min(v, x) as v0 from th group by 1),
  ap as (select g.horizon, g.y, g.x as p, case when g.x <= x0 then v0 when th.x1 is null then th.v else th.v + (th.v1 - th.v) * (g.x - th.x) / (th.x1 - th.x) end as q from gr g join lo using (horizon) asof left join th on g.horizon = th.horizon and g.x >= th.x where g.date >= date '{CUT}'),
  legs as (select horizon, y, 'base' as leg, p as q from ap union all select horizon, y, 'isotonic', q from ap), be as (select horizon, leg, least(floor(q * 10), 9)::int as bin, q, y from legs),
  ec as (select horizon, leg, sum(n * gap) / sum(n) as ece from (select horizon, leg, bin, count(*) as n, abs(avg(q) - avg(y)) as gap from be group by all) group by all)"""


@query("isotonic_calibration", "CA3 CA5", f"with {_steps} select horizon, leg, count(*) as n, {q.rs(6, brier='avg(power(q - y, 2))', ece='max(ece)')} from be join ec using (horizon, leg) group by all")
def isotonic_calibration(spark, sf):
    """Scores on a grid of thousandths, fitted before the cut date and judged after it."""
    d = labelled(spark, sf).withColumn("p_up", F.floor(F.col("p_up") * 1000) / 1000)
    cut = F.lit(CUT).cast("date")
    return rnd(isotonic.calibrate_and_evaluate(d.filter(F.col("date") < cut), d.filter(F.col("date") >= cut), ["horizon"], legs=("base", "isotonic")))


XS, YS = [0.1, 0.3, 0.5, 0.7, 0.9], [0.25, 0.4, 0.5, 0.58, 0.8]
_pw = "case when p_up < 0.1 then 0.25::double " + " ".join(f"when p_up < {XS[i + 1]} then {YS[i]} + ({YS[i + 1]} - {YS[i]})::double * (p_up - {XS[i]}) / ({XS[i + 1]} - {XS[i]})" for i in range(4)) + " else 0.8::double end"


@query("stored_calibration", "CA4", f"with {q.SCORES} select symbol, {q.D}, horizon, {q.rs(6, piecewise=_pw, platt='1 / (1 + exp(-(ln(greatest(1e-6, least(1 - 1e-6, p_up)) / (1 - greatest(1e-6, least(1 - 1e-6, p_up)))) * 0.8 - 0.1)))')} from scores")
def stored_calibration(spark, sf):
    s = derive.scores(derive.bars(spark, sf))
    return rnd(s.select("symbol", "date", "horizon", ca.apply_piecewise("p_up", XS, YS).alias("piecewise"), ca.apply_platt("p_up", 0.8, -0.1).alias("platt")))


ALPHAS = [0.05, 0.1, 0.2, 0.5]
CF = f"""{Y}, cal as (select horizon, abs(fwd_ret) as resid from yy where date < date '{CUT}'), cn as (select horizon, count(*) as n from cal group by 1), lv as (select horizon, n, a as alpha, least(1.0::double, ceil((n + 1) * (1 - a)) / n) as level from cn, (values (0.05::double), (0.1::double), (0.2::double), (0.5::double)) t(a)),
  rk as (select horizon, resid, row_number() over (partition by horizon order by resid) - 1 as k from cal), cq as (select lv.horizon, alpha, any_value(n) as n, max(case when k = floor((n - 1) * level) then resid end) + (max(case when k = ceil((n - 1) * level) then resid end) - max(case when k = floor((n - 1) * level) then resid end)) * (any_value((n - 1) * level) - floor(any_value((n - 1) * level))) as q
   from lv join rk using (horizon) where level < 1 group by 1, 2)"""


def _cal(spark, sf):
    return labelled(spark, sf).filter(F.col("date") < F.lit(CUT).cast("date")).withColumn("resid", F.abs("fwd_ret"))


@query("conformal_quantiles", "CA6", f"with {CF} select horizon, {q.r('alpha', 6, 'alpha')}, n, {q.r('q', 6, 'q')} from cq")
def conformal_quantiles(spark, sf):
    return rnd(ca.conformal_quantiles(_cal(spark, sf), ["horizon"], ALPHAS))


@query("conformal_coverage", "CA7", f"with {CF}, i as (select yy.horizon, alpha, fwd_ret, -q as lo, q as hi from yy join cq using (horizon) where date >= date '{CUT}') select horizon, {q.r('alpha', 6, 'alpha')}, count(*) as n, {q.rs(6, coverage='avg((fwd_ret >= lo and fwd_ret <= hi)::int)', mean_width='avg(hi - lo)')} from i group by horizon, alpha")
def conformal_coverage(spark, sf):
    cq = ca.conformal_quantiles(_cal(spark, sf), ["horizon"], ALPHAS).select("horizon", "alpha", "q")
    v = labelled(spark, sf).filter(F.col("date") >= F.lit(CUT).cast("date")).join(cq, "horizon").withColumns({"lo": -F.col("q"), "hi": F.col("q")})
    return rnd(ca.coverage(v, ["horizon", "alpha"], y="fwd_ret"))


SETS = f"""{Y}, lc as (select horizon, case when y = 1 then 1 - p_up else p_up end as resid from yy where date < date '{CUT}'), ln_ as (select horizon, count(*) as n, least(1.0::double, ceil((count(*) + 1) * 0.8) / count(*)) as level from lc group by 1), lq as (select lc.horizon, quantile_cont(resid, 0.5) as dummy from lc group by 1),
  lr as (select horizon, resid, row_number() over (partition by horizon order by resid) - 1 as k from lc), sq as (select horizon, max(case when k = floor((n - 1) * level) then resid end) + (max(case when k = ceil((n - 1) * level) then resid end) - max(case when k = floor((n - 1) * level) then resid end)) * (any_value((n - 1) * level) - floor(any_value((n - 1) * level))) as q from ln_ join lr using (horizon) group by 1),
  sets as (select yy.*, q, (p_up <= q)::int as has0, (1 - p_up <= q)::int as has1 from yy join sq using (horizon) where date >= date '{CUT}')"""


def sets(spark, sf):
    d, cut = labelled(spark, sf), F.lit(CUT).cast("date")
    cal = d.filter(F.col("date") < cut).withColumn("resid", F.when(F.col("y") == 1, 1 - F.col("p_up")).otherwise(F.col("p_up")))
    cq = ca.conformal_quantiles(cal, ["horizon"], [0.2]).select("horizon", "q")
    return ca.prediction_sets(d.filter(F.col("date") >= cut), cq, ["horizon"])


@query("prediction_sets", "CA8", f"with {SETS} select symbol, {q.D}, horizon, has0, has1, {q.r('case when has0 <> has1 then 0.5 else 0.0 end', 6, 'set_confidence')} from sets")
def prediction_sets(spark, sf):
    return rnd(sets(spark, sf).select("symbol", "date", "horizon", "has0", "has1", "set_confidence"))


@query("coverage_bootstrap", "CA9", None)
def coverage_bootstrap(spark, sf):
    s = sets(spark, sf).withColumn("covered", F.when(F.col("y") == 1, F.col("has1")).otherwise(F.col("has0")))
    return rnd(ca.coverage_bootstrap(s, ["horizon"]))


@query("width_bins", "CA10", f"""with {Y}, wv as (select horizon, 0.3 * abs(p_up - 0.5) + 0.05 as width, abs(fwd_ret) as error from yy), c as (select horizon, quantile_cont(width, [0.2, 0.4, 0.6, 0.8]) as cuts from wv group by 1), b as (select wv.*, len(list_filter(cuts, lambda e: e < width)) as bin from wv join c using (horizon))
  select horizon, bin, count(*) as n, {q.rs(6, mean_width='avg(width)', violation='avg((error > width)::int)', error_90='quantile_cont(error, 0.9)')} from b group by 1, 2""")
def width_bins(spark, sf):
    d = labelled(spark, sf).select("horizon", (0.3 * F.abs(F.col("p_up") - 0.5) + 0.05).alias("width"), F.abs("fwd_ret").alias("error"))
    return rnd(ca.width_bins(d, ["horizon"]))


_t = [0.1, 0.3, 0.45]
_two = f"{SETS}, cs as (select horizon, case when has0 <> has1 then 0.5 else 0.0 end as a, 2 * abs(p_up - 0.5) as b, ((p_up > 0.5 and fwd_ret > 0) or (p_up < 0.5 and fwd_ret < 0))::int as hit from sets)"


@query("confidence_sources", "CA11", f"""with {_two}, g as (select horizon, t as threshold, sum((a >= t)::int) as na, avg(case when a >= t then hit end) as ha, sum((b >= t)::int) as nb, avg(case when b >= t then hit end) as hb from cs, (values (0.1::double), (0.3::double), (0.45::double)) x(t) group by 1, 2)
  select horizon, {q.r('threshold', 6, 'threshold')}, na as samples_a, nb as samples_b, {q.rs(6, hit_rate_a='case when na >= 5 then ha end', hit_rate_b='case when nb >= 5 then hb end')} from g""")
def confidence_sources(spark, sf):
    s = sets(spark, sf).withColumns({"conf_p": 2 * F.abs(F.col("p_up") - 0.5), "actual_return": F.col("fwd_ret"),
                                     "hit": ((F.col("p_up") > 0.5) & (F.col("fwd_ret") > 0)) | ((F.col("p_up") < 0.5) & (F.col("fwd_ret") < 0))})
    return rnd(ca.compare_confidences(s, "set_confidence", "conf_p", _t, ["horizon"]))


_g4 = [0.0, 0.2, 0.4, 0.6]
SEG = f"""{SAMPLES}, sg as (select *, year(latest_date) as seg from samples), sc2 as (select seg, t as threshold, sum((confidence >= t)::int) as n, avg(case when confidence >= t then h end) as hr from sg, (values (0.0::double), (0.2::double), (0.4::double), (0.6::double)) x(t) group by 1, 2),
  mono as (select seg, count(*) as points, min(ok) as monotone from (select seg, (hr >= coalesce(lag(hr) over (partition by seg order by threshold), hr) - 0.005)::int as ok from sc2 where n >= 5) group by 1)"""


def _mono(spark, sf):
    return ca.monotone_segments(samples(spark, sf).withColumn("seg", F.year("latest_date")), "seg", _g4)


@query("holdout_monotonicity", "CA12", f"with {SEG} select seg, points, monotone from mono")
def holdout_monotonicity(spark, sf):
    return _mono(spark, sf)


@query("holdout_stability", "CA13", f"with {SEG} select count(*) as segments, {q.r('avg(monotone)', 6, 'stable_share')}, (min(monotone) = 1)::int as all_stable from mono")
def holdout_stability(spark, sf):
    return rnd(ca.stability(_mono(spark, sf)))


@query("threshold_gate", "CA14", f"""with {SAMPLES}, s as (select horizon, t as threshold, sum((confidence >= t)::int) as n, count(*) as total, avg(case when confidence >= t then h end) as hr from samples, (values (0.0::double), (0.2::double), (0.4::double), (0.6::double)) x(t) group by 1, 2),
  o as (select *, n >= 5 and hr >= 0.49 and n::double / total >= 0.05 and n >= 50 and threshold between 0.1 and 0.9 as ok from s) select horizon, sum(ok::int) as passing, {q.r('min(case when ok then threshold end)', 6, 'recommended')} from o group by 1""")
def threshold_gate(spark, sf):
    return rnd(ca.threshold_gate(threshold_scan(samples(spark, sf), _g4, ["horizon"]), ["horizon"], 0.1, 0.9, min_hit=0.49))
