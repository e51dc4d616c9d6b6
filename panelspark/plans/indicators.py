"""Indicator queries (TI*) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import indicators as ti
from panelspark.operators.blocks import blocked, halo_for
from panelspark.operators.windows import Series, rnd
from panelspark.plans import sqltext as q
from panelspark.plans.registry import query
from panelspark.sources import derive

NZ = "case when ({0}) = 0 then 1e-10::double else ({0}) end"


def nz(e):
    return "(" + NZ.format(e) + ")"


T0 = f"""t0 as (select *, row_number() over ({q.W}) as rn, {q.lag('close')} as pc, {q.lag('high')} as ph, {q.lag('low')} as pl,
    {q.lag('open')} as po, {q.lag('volume')} as pv from bars),
  t1 as (select *, close - pc as d, (high + low + close) / 3 as tp, high - low as hl,
    greatest(high - low, abs(high - pc), abs(low - pc)) as tr from t0)"""


def keep(spark, sf, fn, cols, digits=6, **dg):
    df = fn(derive.bars(spark, sf))
    return rnd(df.select("symbol", "date", *cols), digits, **dg)


def final(cols: dict[str, str], src: str, digits=6, ints=()):
    body = ", ".join(f"{e} as {n}" if n in ints else q.r(e, digits, n) for n, e in cols.items())
    return f"select symbol, {q.D}, {body} from {src}"


# ---- TI1-TI7, TI39
_w = (5, 10, 20, 60)
_base = f"""b1 as (select *, {", ".join(f"{q.avg('close', w)} as ma_{w}" for w in _w)},
   {", ".join(f"close / {q.lag('close', n)} - 1 as ret_{n}" for n in (1, 5, 10))}, {q.sd('close', 20)} as sd20, {q.avg('volume', 20)} as va, d
   from t1), b2 as (select *, {q.avg('case when d > 0 then d when d <= 0 then 0.0 end', 14)} as g,
   {q.avg('case when d < 0 then -d when d >= 0 then 0.0 end', 14)} as l, {q.sd('ret_1', 20)} as volatility from b1)"""
_bc = {**{f"ma_{w}": f"ma_{w}" for w in _w}, **{f"ma_{w}_ratio": f"close / ma_{w} - 1" for w in _w}, "ret_1": "ret_1", "ret_5": "ret_5",
       "ret_10": "ret_10", "rsi": "100 - 100 / (1 + g / (l + 1e-9))", "volatility": "volatility", "boll_upper": "ma_20 + 2 * sd20",
       "boll_lower": "ma_20 - 2 * sd20", "boll_pos": f"(close - (ma_20 - 2 * sd20)) / {nz('(ma_20 + 2 * sd20) - (ma_20 - 2 * sd20)')}",
       "volume_ratio": f"volume / {nz('va')}"}
_bc["boll_pct_b"] = _bc["boll_pos"]


@query("base_features", "TI1 TI2 TI3 TI4 TI6 TI7 TI39", f"with {q.BARS}, {T0}, {_base} {final(_bc, 'b2', 5)}")
def base_features(spark, sf):
    return keep(spark, sf, ti.base_features, list(_bc), 5)


# ---- trailing set
_tr = f"""u1 as (select *, {", ".join(f"(({q.sm('rn * close', w)}) - (rn - {w}) * {q.sm('close', w)}) / {w * (w + 1) / 2} as wma_{w}" for w in (10, 20))},
   {", ".join(f"(close / {q.lag('close', w)} - 1) * 100 as roc_{w}, close - {q.lag('close', w)} as mom_{w}" for w in (10, 20))},
   {q.avg('close', 12)} as sma12, {q.avg('close', 20)} as sma20, {q.mx('high', 14)} as hi14, {q.mn('low', 14)} as lo14,
   {q.sm('tr', 14)} as tr14, {q.avg('tp', 14)} as tpm, {q.avg('tp', 14, f='list')} as tps,
   {q.sm('abs(high - pl)', 14)} as vp, {q.sm('abs(low - ph)', 14)} as vm,
   {q.sm('case when d > 0 then d else 0.0 end', 14)} as ge, {q.sm('case when d < 0 then -d else 0.0 end', 14)} as ls,
   {q.lag('tp')} as ptp, {q.sd('close', 14)} as stddev, (2 * close - low - high) / {nz('hl')} * volume as mfm,
   (high + low - ph - pl) / 2 / {nz(f"volume / 1e8::double / {nz('hl')}")} as eo,
   {q.avg('high', 15, f='list')} as h15, {q.avg('low', 15, f='list')} as l15 from t1),
  u2 as (select *, (close - lo14) / {nz('hi14 - lo14')} * 100 as stoch_k,
   {q.sm('case when tp > ptp then tp * volume else 0.0 end', 14)} as pmf, {q.sm('case when tp < ptp then tp * volume else 0.0 end', 14)} as nmf from u1),
  u3 as (select *, {q.avg('sma12', 12)} as trima_12, {q.avg('sma20', 20)} as trima_20, {q.sm('mfm', 20)} as mfm20, {q.sm('volume', 20)} as v20,
   {q.avg('eo', 14)} as eom, {q.avg('stoch_k', 3)} as stoch_d from u2)"""
_tc = {"wma_10": "wma_10", "wma_20": "wma_20", "trima_12": "trima_12", "trima_20": "trima_20",
       "aroon_up": "100.0 * (list_position(h15, list_max(h15)) - 1) / 14", "aroon_down": "100.0 * (list_position(l15, list_min(l15)) - 1) / 14",
       "cci": f"(tp - tpm) / (0.015 * {nz('list_sum(list_transform(tps, lambda x: abs(x - tpm))) / 14')})",
       "vi_plus": f"vp / {nz('tr14')}", "vi_minus": f"vm / {nz('tr14')}", "stoch_k": "stoch_k", "stoch_d": "stoch_d",
       "willr": f"(hi14 - close) / {nz('hi14 - lo14')} * -100", "roc_10": "roc_10", "roc_20": "roc_20", "mom_10": "mom_10", "mom_20": "mom_20",
       "cmo": f"100 * (ge - ls) / {nz('ge + ls')}", "mfi": f"100 - 100 / (1 + pmf / {nz('nmf')})", "stddev": "stddev",
       "choppiness": f"100 * log10(tr14 / {nz('hi14 - lo14')}) / log10(14.0)", "cmf": f"mfm20 / {nz('v20')}", "eom_e8": "eom / 1e8::double"}


@query("trailing_indicators", "TI11 TI13 TI16 TI17 TI18 TI20 TI21 TI22 TI24 TI25 TI29 TI32 TI36",
       f"with {q.BARS}, {T0}, {_tr} {final(_tc, 'u3', 4)}")
def trailing_indicators(spark, sf):
    return keep(spark, sf, lambda b: ti.trailing_indicators(b).withColumn("eom_e8", F.col("eom") / 1e8), list(_tc), 4)


_cum = f"over ({q.W} rows between unbounded preceding and current row)"
_cc = {"obv": f"sum(sign(coalesce(d, 0)) * volume) {_cum}", "vwap": f"sum(tp * volume) {_cum} / sum(volume) {_cum}",
       "ad_line": f"sum((2 * close - low - high) / {nz('hl')} * volume) {_cum}", "pvt": f"sum(coalesce(d / pc, 0) * volume) {_cum}",
       "nvi_log": f"log10(1000.0) + sum(log10(case when volume < pv then 1 + coalesce(d / pc, 0) else 1.0 end)) {_cum}"}


@query("cumulative_indicators", "TI30 TI31 TI33 TI34",
       f"with {q.BARS}, {T0}, c1 as (select symbol, date, {', '.join(f'{e} as {n}' for n, e in _cc.items())} from t1) "
       + final({c: c for c in _cc}, "c1", 4))
def cumulative_indicators(spark, sf):
    return keep(spark, sf, lambda b: ti.cumulative_indicators(b).withColumn("nvi_log", F.log10("nvi")), list(_cc), 4)


_piv = "(ph + pl + pc) / 3"
_pc = {"pivot": _piv, "r1": f"2 * ({_piv}) - pl", "s1": f"2 * ({_piv}) - ph", "r2": f"{_piv} + (ph - pl)", "s2": f"{_piv} - (ph - pl)",
       "doji": f"case when abs(close - open) / {nz('hl')} < 0.1 then 1 else 0 end",
       "hammer": "case when least(open, close) - low > 2 * abs(close - open) and high - greatest(open, close) < abs(close - open) and abs(close - open) > 0 then 1 else 0 end",
       "engulfing": "case when close > open and pc < po and close >= po and open <= pc then 1 else 0 end",
       "morning_star": f"case when c2 < o2 and abs(pc - po) / {nz('phl')} < 0.1 and close > open and close > (o2 + c2) / 2 then 1 else 0 end"}


@query("candle_patterns", "TI37 TI38",
       f"with {q.BARS}, {T0}, p1 as (select *, {q.lag('open', 2)} as o2, {q.lag('close', 2)} as c2, {q.lag('hl')} as phl from t1) "
       + final(_pc, "p1", 6, ("doji", "hammer", "engulfing", "morning_star")))
def candle_patterns(spark, sf):
    return keep(spark, sf, ti.patterns, list(_pc))


# ---- recursive set: one recursive CTE carries every state
def _step(a, x, prev):
    return f"({a} * ({x}) + (1 - {a}) * ({prev}))"


def recursive_sql(source: str, states: list[tuple[str, str, str, str]], carry: str, keys: str = "symbol") -> str:
    """``states``: (name, weight, input as SQL over b.* and already advanced states in braces, first value)."""
    first = ", ".join(f"cast({init} as double) as {n}" for n, _, _, init in states)
    done: dict[str, str] = {}
    for n, a, x, _ in states:
        done[n] = _step(a, x.format(**done), f"r.{n}")
    nxt = ", ".join(done.values())
    return f"""rec as (select {keys}, rn, {carry.replace('b.', '')}, {first} from {source} where rn = 1
      union all select {', '.join('b.' + k.strip() for k in keys.split(','))}, b.rn, {carry}, {nxt} from rec r join {source} b
      on {' and '.join(f'b.{k.strip()} = r.{k.strip()}' for k in keys.split(','))} and b.rn = r.rn + 1)"""


def a_span(n):
    return repr(2 / (n + 1))


_states = [*[(f"ema_{w}", a_span(w), "b.close", "close") for w in (5, 10, 20, 60)],
           ("e12", a_span(12), "b.close", "close"), ("e26", a_span(26), "b.close", "close"), ("macd_signal", a_span(9), "{e12} - {e26}", "0"),
           ("q12", a_span(12), "{e12}", "close"), ("w12", a_span(12), "{q12}", "close"),
           ("d10", a_span(10), "{ema_10}", "close"), ("g10", a_span(10), "{d10}", "close"),
           ("d20", a_span(20), "{ema_20}", "close"), ("g20", a_span(20), "{d20}", "close"),
           ("atr", repr(1 / 14), "b.tr", "tr"), ("pdm", repr(1 / 14), "b.pdm", "pdm"), ("mdm", repr(1 / 14), "b.mdm", "mdm"),
           ("r9", a_span(9), "b.hl", "hl"), ("rr9", a_span(9), "{r9}", "hl")]
_rec1 = f"""k0 as (select symbol, rn, date, close, tr, hl, case when high - ph > pl - low and high - ph > 0 then high - ph else 0.0 end as pdm,
    case when pl - low > high - ph and pl - low > 0 then pl - low else 0.0 end as mdm from t1)"""
_rsel = {**{f"ema_{w}": f"ema_{w}" for w in (5, 10, 20, 60)}, "macd": "e12 - e26", "macd_signal": "macd_signal", "macd_hist": "e12 - e26 - macd_signal",
         "dema_10": "2 * ema_10 - d10", "tema_10": "3 * ema_10 - 3 * d10 + g10", "dema_20": "2 * ema_20 - d20", "tema_20": "3 * ema_20 - 3 * d20 + g20",
         "atr": "atr", "natr": f"atr / {nz('close')} * 100", "trix": f"(w12 / {q.lag('w12')} - 1) * 100",
         "mass_index": q.sm(f"r9 / {nz('rr9')}", 25)}


@query("exponential_averages", "TI5 TI10 TI12 TI23 TI27 TI28",
       f"with recursive {q.BARS}, {T0}, {_rec1}, {recursive_sql('k0', _states, 'b.date, b.close')}, z as (select symbol, date, "
       + ", ".join(f"{e} as {n}" for n, e in _rsel.items()) + " from rec) " + final({c: c for c in _rsel}, "z", 4))
def exponential_averages(spark, sf):
    return keep(spark, sf, ti.recursive_indicators, list(_rsel), 4)


def _ewm_late(name, a, x, out):  # series whose first value arrives later: start at the first non-null row
    return (f"{name}s as (select symbol, date, {x} as x, row_number() over ({q.W}) as rn from {out[0]} where {x} is not null), "
            + f"{name} as (select symbol, rn, date, x as y from {name}s where rn = 1 union all select b.symbol, b.rn, b.date, "
            + f"{_step(a, 'b.x', 'r.y')} from {name} r join {name}s b on b.symbol = r.symbol and b.rn = r.rn + 1)")


_adx = f"""dx0 as (select symbol, date, 100 * abs(100 * pdm / {nz('atr')} - 100 * mdm / {nz('atr')})
    / {nz(f"100 * pdm / {nz('atr')} + 100 * mdm / {nz('atr')}")} as dx from rec)"""
_kdj = f"kr as (select symbol, date, (close - {q.mn('low', 9)}) / {nz(q.mx('high', 9) + ' - ' + q.mn('low', 9))} * 100 as rsv from t1)"
_ratio = f"tsr as (select a.symbol, a.date, a.y / {nz('b.y')} as x from tsa a join tsb b on a.symbol = b.symbol and a.date = b.date)"
_all = f"""with recursive {q.BARS}, {T0}, {_rec1}, {recursive_sql('k0', _states, 'b.date, b.close')}, {_adx},
  {_ewm_late('adx', repr(1 / 14), 'dx', ('dx0',))}, {_kdj}, {_ewm_late('kk', repr(1 / 3), 'rsv', ('kr',))},
  {_ewm_late('dd', repr(1 / 3), 'y', ('kk',))}, {_ewm_late('tsa', a_span(25), 'd', ('t1',))}, {_ewm_late('tsb', a_span(25), 'abs(d)', ('t1',))},
  {_ratio}, {_ewm_late('tsi', a_span(13), 'x', ('tsr',))}, {_ewm_late('fi', a_span(13), 'd * volume', ('t1',))},
  ka as (select symbol, date, rn, close, power(coalesce(abs(close - {q.lag('close', 10)}) / {nz(q.sm('abs(d)', 10))}, 0) * {2 / 3 - 2 / 31!r} + {2 / 31!r}, 2) as sc from t1),
  kama as (select symbol, date, rn, close as y from ka where rn = 1 union all select b.symbol, b.date, b.rn,
     case when b.rn <= 10 then b.close else r.y + b.sc * (b.close - r.y) end from kama r join ka b on b.symbol = r.symbol and b.rn = r.rn + 1),
  z as (select bars.symbol, bars.date, adx.y as adx, (adx.y + lag(adx.y, 14) over (partition by bars.symbol order by bars.date)) / 2 as adxr,
     kk.y as kdj_k, dd.y as kdj_d, 3 * kk.y - 2 * dd.y as kdj_j, tsi.y * 100 as tsi, fi.y as force_index, kama.y as kama from bars
     left join adx using (symbol, date) left join kk using (symbol, date) left join dd using (symbol, date)
     left join tsi using (symbol, date) left join fi using (symbol, date) left join kama using (symbol, date)) """
_late = ["adx", "adxr", "kdj_k", "kdj_d", "kdj_j", "tsi", "force_index", "kama"]


@query("recursive_oscillators", "TI14 TI15 TI19 TI26 TI35", _all + final({c: c for c in _late}, "z", 4))
def recursive_oscillators(spark, sf):
    return keep(spark, sf, ti.recursive_indicators, _late, 4)


@query("support_resistance", "TI40", f"""with {q.BARS} select symbol, {q.D},
  {q.r(f"case when count(close) over ({q.W} rows between 20 preceding and 1 preceding) >= 20 then min(low) over ({q.W} rows between 20 preceding and 1 preceding) end", 6, 'support')},
  {q.r(f"case when count(close) over ({q.W} rows between 20 preceding and 1 preceding) >= 20 then max(high) over ({q.W} rows between 20 preceding and 1 preceding) end", 6, 'resistance')}
  from bars""")
def support_resistance(spark, sf):
    return keep(spark, sf, ti.support_resistance, ["support", "resistance"])


@query("label_volatility", "TI41", f"""with {q.BARS}, x as (select *, ln(close / {q.lag('close')}) as lr from bars)
  select symbol, {q.D}, {q.r(f"case when count(*) over ({q.W} rows between 19 preceding and current row) >= 5 then stddev_samp(lr) over ({q.W} rows between 18 preceding and current row) end", 6, 'sigma')} from x""")
def label_volatility(spark, sf):
    return keep(spark, sf, ti.label_volatility, ["sigma"])


@query("minmax_scores", "TI42", f"""with {q.BARS}, x as (select *, min(close) over w as lo, max(close) over w as hi, min(volume) over w as lv, max(volume) over w as hv
  from bars window w as ({q.W} rows between 59 preceding and current row))
  select symbol, {q.D}, {q.rs(6, close_score='coalesce(case when hi - lo > 1e-12 then 2 * (close - lo) / (hi - lo) - 1 end, 0.0)',
                              volume_score='coalesce(case when hv - lv > 1e-12 then 2 * (volume - lv) / (hv - lv) - 1 end, 0.0)')} from x""")
def minmax_scores(spark, sf):
    return keep(spark, sf, lambda b: ti.minmax_scores(b, ["close", "volume"]), ["close_score", "volume_score"])


@query("tick_blocked_features", "TI10 ST-R4", f"""with recursive t as (select event_id, event_type as symbol, ts, value as price,
    row_number() over (partition by event_type order by ts, event_id) as rn from events),
  e as (select symbol, rn, event_id, price as ewm from t where rn = 1 union all
    select b.symbol, b.rn, b.event_id, {_step(a_span(20), 'b.price', 'r.ewm')} from e r join t b on b.symbol = r.symbol and b.rn = r.rn + 1),
  m as (select event_id, {q.avg('price', 50, w='partition by symbol order by rn')} as ma_50 from t)
  select event_id, symbol, {q.rs(4, ewm='ewm', ma_50='ma_50')} from e join m using (event_id)""")
def tick_blocked_features(spark, sf):
    """Trailing mean and exponential average over ticks: no bound on rows per symbol, so blocks with warm-up rows."""
    t = derive.ticks(spark, sf).select("symbol", "ts", "event_id", "price")
    a = 2 / 21
    b = blocked(t, ["symbol"], ["ts", "event_id"], halo=max(halo_for(a), 50))
    s = Series(keys=("symbol", "_blk"), order=("pos",))
    b = b.withColumn("ma_50", s.mean("price", 50))
    from panelspark.operators.recursion import ewm, with_recursive
    out = with_recursive(b, lambda p: {"ewm": ewm(p["price"], alpha=a)}, ["ewm"], keys=("symbol", "_blk"), order=("pos",), warm="_warm")
    return rnd(out.select("event_id", "symbol", "ewm", "ma_50"), 4)
