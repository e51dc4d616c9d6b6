"""Factor queries (FA*, A*, SG7, SG8, SO6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import factors as fa
from panelspark.operators.windows import Series, rnd
from panelspark.plans import sqltext as q
from panelspark.plans.indicators import T0, _step, a_span, nz, recursive_sql
from panelspark.plans.registry import query
from panelspark.sources import derive


def sq(e):
    return f"tanh(coalesce(case when isfinite({e}) then {e} end, 0.0))"


def n0(e):
    return f"nullif({e}, 0)"


def z0(c, n=252, m=5):
    fr = f"over ({q.W} rows between {n - 1} preceding and current row)"
    return (f"coalesce(case when count({c}) {fr} >= {m} and max({c}) {fr} > min({c}) {fr} "
            f"then ({c} - avg({c}) {fr}) / stddev_samp({c}) {fr} end, 0.0)")


def smooth(e, n=5):
    a = f"avg({e}) over ({q.W} rows between {n - 1} preceding and current row)"
    return f"greatest(-1.0, least(1.0, coalesce({a}, 0.0)))"


_states = [("e12", a_span(12), "b.close", "close"), ("e26", a_span(26), "b.close", "close"), ("sg", a_span(9), "{e12} - {e26}", "0")]
_f = f"""{recursive_sql('t1', _states, 'b.date')},
  kr as (select symbol, date, (close - {q.mn('low', 9, 3)}) / {n0(q.mx('high', 9, 3) + ' - ' + q.mn('low', 9, 3))} * 100 as x from t1),
  ks as (select symbol, date, x, row_number() over ({q.W}) as rn from kr where x is not null),
  kd as (select symbol, rn, date, x as k, x as dd from ks where rn = 1 union all select b.symbol, b.rn, b.date,
    {_step('1/3.0::double', 'b.x', 'r.k')}, {_step('1/3.0::double', _step('1/3.0::double', 'b.x', 'r.k'), 'r.dd')}
    from kd r join ks b on b.symbol = r.symbol and b.rn = r.rn + 1),
  f0 as (select t1.*, e12 / e26 - 1 as slope, e12 - e26 - sg as mh, 3 * k - 2 * dd as j, high - ph as up, pl - low as dn, close / pc - 1 as ret
    from t1 join rec using (symbol, rn) left join kd on kd.symbol = t1.symbol and kd.date = t1.date),
  f1 as (select *, case when up > dn and up > 0 then up else 0.0 end as pdm, case when dn > up and dn > 0 then dn else 0.0 end as mdm,
    sum(sign(coalesce(d, 0)) * volume) over ({q.W} rows between unbounded preceding and current row) as obv,
    coalesce((2 * close - low - high) / {n0('hl')}, 0.0) * volume as mfv, {q.sd('ret', 20, 5)} as vol,
    {q.avg('case when d is not null then greatest(d, 0.0) end', 14, 5)} as g, {q.avg('case when d is not null then greatest(-d, 0.0) end', 14, 5)} as l from f0),
  f2 as (select *, {q.avg('tr', 14, 5)} as atr5, coalesce(obv - {q.lag('obv', 5)}, 0.0) as obv5, {q.avg('close', 20, 5)} as ma, {q.sd('close', 20, 5)} as sd,
    100 * {q.avg('pdm', 14, 5)} as pd0, 100 * {q.avg('mdm', 14, 5)} as md0 from f1),
  f3 as (select *, pd0 / {n0('atr5')} as p, md0 / {n0('atr5')} as m, -(atr5 / (abs(close) + 1e-9)) as natr from f2),
  f4 as (select *, 100 * abs(p - m) / {n0('p + m')} as dx from f3)"""
_fx = {"factor_ma_bias": sq("(close / ma - 1) * 10"), "factor_ema_slope": sq("slope * 15"),
       "factor_adx_strength": f"tanh(sign(coalesce(p - m, 0)) * coalesce({q.avg('dx', 14, 5)}, 0.0) / 50 * 2)",
       "factor_rsi_score": sq("(100 - 100 / (1 + g / (l + 1e-9)) - 50) / 25"), "factor_roc": f"tanh(coalesce((close / {q.lag('close', 20)} - 1) * 10, 0.0))",
       "factor_macd_hist": sq("mh / (abs(close) + 1e-9) * 200"), "factor_volatility": f"tanh(-{z0('vol')})", "factor_atr_ratio": f"tanh({z0('natr')})",
       "factor_volume_ratio": f"tanh(coalesce(volume / {n0(q.avg('volume', 20, 5))} - 1, 0.0))", "factor_obv_slope": f"tanh({z0('obv5')})",
       "factor_cmf": f"tanh(coalesce({q.sm('mfv', 20, 5)} / {n0(q.sm('volume', 20, 5))}, 0.0))",
       "factor_boll_revert": sq("-(close - ma) / (2 * sd + 1e-9)"), "factor_kdj_score": sq("-(coalesce(j, 50.0) - 50) / 50")}
FACTORS = f"{q.BARS}, {T0}, {_f}, f5 as (select symbol, date, {', '.join(f'{e} as {n}' for n, e in _fx.items())} from f4), " \
          f"factors as (select symbol, date, {', '.join(f'{smooth(n)} as {n}' for n in _fx)} from f5)"


@query("price_factors", "FA1 FA2 FA3 FA4 FA5 FA8", f"with recursive {FACTORS} select symbol, {q.D}, {', '.join(q.r(n, 6, n) for n in _fx)} from factors")
def price_factors(spark, sf):
    return rnd(fa.price_factors(derive.bars(spark, sf)).select("symbol", "date", *_fx))


# ---- rolling factor matrix
_k = {"KMID": "(close - open) / open", "KLEN": "hl / open", "KUP": "(high - greatest(open, close)) / open",
      "KLOW": "(least(open, close) - low) / open", "KSFT": "(close / 2 + open / 2 - high) / open", "KMID2": "(close - open) / ((high + low) / 2)",
      "KUP2": "(high - greatest(open, close)) / ((high + low) / 2)", "KLOW2": "(least(open, close) - low) / ((high + low) / 2)"}


def _fr(w):
    return f"over ({q.W} rows between {w - 1} preceding and current row)"


def _full(e, w, rows=None):
    return f"case when rn >= {rows or w} then {e} {_fr(w)} end"


def _alpha(w):
    return {f"ROC{w}": f"c{w} / close", f"MA{w}": _full("avg(close)", w), f"STD{w}": _full("stddev_samp(close)", w),
            f"BETA{w}": _full("regr_slope(close, rn)", w),
            f"RSQR{w}": f"case when rn >= {w} and max(close) {_fr(w)} > min(close) {_fr(w)} then regr_r2(close, rn) {_fr(w)} end",
            f"RESI{w}": f"close - {_full('avg(close)', w)} - {_full('regr_slope(close, rn)', w)} * {(w - 1) / 2}",
            f"QTLU{w}": _full("quantile_cont(close, 0.8)", w), f"QTLD{w}": _full("quantile_cont(close, 0.2)", w),
            f"RANK{w}": f"case when rn >= {w} then (len(list_filter(list(close) {_fr(w)}, lambda x: x < close)) + (len(list_filter(list(close) {_fr(w)}, lambda x: x = close)) + 1) / 2.0) / {w} end",
            f"RSV{w}": f"case when rn >= {w} and max(high) {_fr(w)} - min(low) {_fr(w)} > 1e-12 then (close - min(low) {_fr(w)}) / (max(high) {_fr(w)} - min(low) {_fr(w)}) end",
            f"CORR{w}": _full("corr(close, volume)", w), f"CORD{w}": _full(f"corr(close - c{w}, volume)", w, 2 * w),
            f"CNTP{w}": _full(f"avg(case when close > c{w} then 1.0::double else 0.0::double end)", w), f"SUMP{w}": q.sm("g", w), f"VSUMP{w}": q.sm("vg", w),
            f"VMA{w}": q.avg("volume", w), f"VSTD{w}": q.sd("volume", w), f"WVMA{w}": q.sd("av", w)}


def a0(windows):
    return (f"a0 as (select *, abs(close / pc - 1) * volume as av, case when pc is not null then greatest(close - pc, 0.0) end as g, "
            f"case when pv is not null then greatest(volume - pv, 0.0) end as vg, {', '.join(q.lag('close', w) + f' as c{w}' for w in windows)} from t1)")


def _matrix(stems, windows, digits=3):
    cols = {n: e for w in windows for n, e in _alpha(w).items() if n.rstrip("0123456789") in stems}
    inner = ", ".join(f"{e} as {n}" for n, e in cols.items())
    return (f"with {q.BARS}, {T0}, {a0(windows)}, a1 as (select symbol, date, {inner} from a0) select symbol, {q.D}, "
            + ", ".join(q.r(n, digits, "A158_" + n) for n in cols) + " from a1"), ["A158_" + n for n in cols]


@query("candle_factors", "A1", f"with {q.BARS}, {T0} select symbol, {q.D}, {', '.join(q.r(e, 6, 'A158_' + n) for n, e in _k.items())} from t1")
def candle_factors(spark, sf):
    return rnd(fa.factor_matrix(derive.bars(spark, sf)).select("symbol", "date", *["A158_" + n for n in _k]))


def _register(name, ids, stems):
    sql, cols = _matrix(stems, fa.WINDOWS)

    @query(name, ids, sql)
    def run(spark, sf, cols=cols):
        return rnd(fa.factor_matrix(derive.bars(spark, sf)).select("symbol", "date", *cols), 3)


_register("rolling_factors", "A2 A6 A8", ("ROC", "MA", "STD", "RSV", "CNTP", "SUMP", "VSUMP", "VMA", "VSTD", "WVMA"))
_register("regression_factors", "A3", ("BETA", "RSQR", "RESI"))
_register("rank_quantile_factors", "A4 A5", ("QTLU", "QTLD", "RANK"))
_register("correlation_factors", "A7", ("CORR", "CORD"))

_cw = (5, 20)
_terms = {f: [(s, f"{st}{w}") for s, stems, _ in parts for st in stems for w in _cw] + [(s, k) for s, _, ks in parts for k in ks]
          for f, parts in fa.COMPRESSED.items()}
_need = {n: e for w in _cw for n, e in _alpha(w).items() if n.rstrip("0123456789") not in ("BETA", "RSQR", "RESI", "CORD")} | _k
_comp = (f"with {q.BARS}, {T0}, {a0(_cw)}, a1 as (select symbol, date, {', '.join(f'{e} as {n}' for n, e in _need.items())} from a0), a2 as (select symbol, date, "
         + ", ".join(f"tanh(({' + '.join(f'({s}) * {z0(c, 120, 20)}' for s, c in ts)}) / {len(ts)}) as factor_a158_{f}" for f, ts in _terms.items())
         + f" from a1) select symbol, {q.D}, " + ", ".join(q.r(f"factor_a158_{f}", 5, f"factor_a158_{f}") for f in _terms)
         + ", 1.0::double as factor_a158_available from a2")


@query("compressed_factors", "A9", _comp)
def compressed_factors(spark, sf):
    d = fa.compressed_factors(derive.bars(spark, sf), windows=_cw)
    return rnd(d.select("symbol", "date", *[f"factor_a158_{f}" for f in _terms], "factor_a158_available"), 5)


# ---- blending
PRIOR = {"factor_ma_bias": 0.3, "factor_rsi_score": 0.2, "factor_volatility": 0.2, "factor_volume_ratio": 0.1, "factor_boll_revert": 0.2}


@query("blended_score", "SG7 SF7", f"""with recursive {FACTORS}, p(factor, w) as (values {", ".join(f"('{k}', {v}::double)" for k, v in PRIOR.items())}),
  l as (unpivot (select symbol, date, {", ".join(f"case when abs({k}) > 0.01 then {k} end as {k}" for k in PRIOR)} from factors) on {", ".join(PRIOR)} into name factor value v),
  n as (select symbol, date, {len(PRIOR)} - count(*) as n_missing, sum(w) as tw, sum(w * v) / sum(w) as s from l join p using (factor) group by 1, 2),
  x as (select f.symbol, f.date, coalesce(n_missing, {len(PRIOR)}) as n_missing, coalesce(s, 0.0) as s from factors f left join n using (symbol, date))
  select symbol, {q.D}, n_missing, case when s > 0.05 then 'up' when s < -0.05 then 'down' else 'neutral' end as direction,
   {q.rs(6, score='s', p_up='0.5 + s / 2', confidence='abs(s)')} from x""")
def blended_score(spark, sf):
    f = fa.price_factors(derive.bars(spark, sf))
    f = f.withColumns({k: F.when(F.abs(k) > 0.01, F.col(k)) for k in PRIOR})
    return rnd(fa.combine(fa.to_long(f, list(PRIOR)), PRIOR, keys=("symbol", "date")))


_fam = ", ".join(f"('{n}', '{f}')" for f, ns in fa.FAMILIES.items() for n in ns if n in _fx)


@query("factor_model_weights", "SG8 SO6", f"""with recursive {FACTORS}, y as (select f.*, lead(close, 5) over (partition by symbol order by date) / close - 1 as target
    from factors f join bars using (symbol, date)),
  l as (unpivot (select symbol, date, target, {", ".join(_fx)} from y where target is not null) on {", ".join(_fx)} into name factor value v),
  ic as ({q.spearman('l', 'factor', 'v', 'target')}), fam(factor, family) as (values {_fam}),
  a as (select *, abs(ic) as a, row_number() over (partition by family order by abs(ic) desc, factor) as rk,
    max(case when abs(ic) >= 0.005 then 1 else 0 end) over (partition by family) as anyp from ic join fam using (factor)),
  b as (select *, case when anyp = 1 then a >= 0.005 and rk <= 8 else rk = 1 end as p from a),
  c as (select *, case when p and a > 0 then a end as v from b),
  d as (select *, coalesce(case when count(v) over f > 0 then 0.65 * v / sum(v) over f + 0.35 / count(v) over f
     when p then 1.0 / sum(p::int) over f end, 0.0) as within, max(a) over f as strength from c window f as (partition by family)),
  e as (select *, strength / (select sum(s) from (select max(a) as s from a group by family)) as fw, sum(within) over (partition by family) as ws from d),
  g as (select *, fw * within / ws as fx from e)
  select factor, family, {q.rs(6, ic='ic', family_weight='fw', weight='fx / (select sum(fx) from g)')} from g""")
def factor_model_weights(spark, sf):
    b = derive.bars(spark, sf)
    s = Series()
    f = fa.price_factors(b).withColumn("target", s.lead("close", 5) / F.col("close") - 1)
    ic = fa.factor_ic(f.filter(F.col("target").isNotNull()), list(_fx), "target")
    fam = F.create_map(*[F.lit(x) for f_, ns in fa.FAMILIES.items() for n in ns for x in (n, f_)])
    return rnd(fa.factor_weights(ic.withColumn("family", fam[F.col("factor")])))
