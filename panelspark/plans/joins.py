"""Join queries (JN*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import scalar as fx
from panelspark.operators import aggregates as ag
from panelspark.operators import factors as fa
from panelspark.operators import joins as jn
from panelspark.operators.windows import Series, rnd
from panelspark.plans import sqltext as q
from panelspark.plans.factors import smooth, z0
from panelspark.plans.registry import query
from panelspark.sources import derive

IND = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_name = {i: "macro_" + i.lower().replace("-", "_").replace(" ", "_") for i in IND}
MF = f"""{q.MACRO}, mf as (select indicator, date, value as latest, value - lag(value) over (partition by indicator order by date) as mom,
  avg(value) over (partition by indicator order by date rows between 2 preceding and current row) as yoy3 from macro)"""
WIDE = "days as (select distinct date from bars), wide as (select date" + "".join(
    f", coalesce(max(case when indicator = '{i}' then {c} end), 0.0) as {_name[i]}_{c}" for i in IND for c in ("latest", "mom", "yoy3")) + \
    " from (select d.date, m.indicator, m.latest, m.mom, m.yoy3 from (select date, unnest(" + str(IND) + ") as ind from days) d asof left join mf m on m.indicator = d.ind and d.date >= m.date) group by 1)"
_mc = [f"{_name[i]}_{c}" for i in IND for c in ("latest", "mom", "yoy3")]


@query("macro_asof", "JN1", f"with {q.BARS}, {MF}, {WIDE} select symbol, {q.D}, {', '.join(q.r(c, 3, c) for c in _mc)} from bars join wide using (date)")
def macro_asof(spark, sf):
    b = derive.bars(spark, sf).select("symbol", "date")
    return rnd(jn.attach_macro(b, derive.macro(spark, sf), IND), 3)


@query("macro_factor", "FA7", f"""with {q.BARS}, {MF}, {WIDE}, m as (select symbol, date, {', '.join(c for c in _mc)} from bars join wide using (date)),
  x as (select symbol, date, tanh(({' + '.join(z0(c) for c in _mc)}) / {len(_mc)}) as f from m) select symbol, {q.D}, {q.r(smooth('f'), 5, 'factor_macro')} from x""")
def macro_factor(spark, sf):
    b = jn.attach_macro(derive.bars(spark, sf).select("symbol", "date"), derive.macro(spark, sf), IND)
    return rnd(fa.macro_factor(b).select("symbol", "date", "factor_macro"), 5)


@query("macro_vector", "JN2", f"with {MF} select indicator, cast(max(date) as varchar) as date, {q.rs(4, latest='arg_max(latest, date)', mom='coalesce(arg_max(mom, date), 0)', yoy3='arg_max(yoy3, date)')} from mf where date <= date '1997-03-15' group by 1")
def macro_vector(spark, sf):
    return rnd(jn.macro_vector(derive.macro(spark, sf), "1997-03-15"), 4)


_sent = f"""{q.NEWS}, c as (select date, regexp_replace(regexp_replace(trim(title), '[^一-龥a-zA-Z0-9]', ' ', 'g'), '\\s+', ' ', 'g') as t from news),
  h as (select date, {" + ".join(f"(contains(t, '{w}'))::int" for w in derive.POSITIVE)} as p, {" + ".join(f"(contains(t, '{w}'))::int" for w in derive.NEGATIVE)} as n from c),
  s as (select date, coalesce((p - n)::double / nullif(p + n, 0), 0.0) as sentiment, coalesce(p::double / nullif(p + n, 0), 0.0) as pos, coalesce(n::double / nullif(p + n, 0), 0.0) as neg from h),
  daily as (select date, avg(sentiment) as sentiment_mean, coalesce(stddev_samp(sentiment), 0.0) as sentiment_std, avg(pos) as positive_mean, avg(neg) as negative_mean, count(*) as news_count from s group by 1)"""


def _daily(spark, sf):
    n = derive.news(spark, sf)
    return ag.daily_sentiment(n.select("date", fx.lexicon_sentiment("title", derive.POSITIVE, derive.NEGATIVE).alias("s")).select("date", "s.*"))


_sc = dict(sentiment_mean="sentiment_mean", sentiment_std="sentiment_std", positive_mean="positive_mean", negative_mean="negative_mean")


@query("daily_sentiment", "AG1", f"with {_sent} select {q.D}, news_count, {q.rs(6, **_sc)} from daily")
def daily_sentiment(spark, sf):
    return rnd(_daily(spark, sf))


@query("sentiment_join", "JN3 FA6", f"""with {q.BARS}, {_sent}, j as (select symbol, date, coalesce(sentiment_mean, 0.0) as sentiment_mean, coalesce(sentiment_std, 0.0) as sentiment_std, coalesce(positive_mean, 0.5) as positive_mean,
   coalesce(negative_mean, 0.5) as negative_mean, coalesce(news_count, 0) as news_count from bars left join daily using (date)), k as (select *, tanh(sentiment_mean) as f from j)
  select symbol, {q.D}, news_count, {q.rs(6, **_sc)}, {q.r(smooth('f'), 6, 'factor_sentiment')} from k""")
def sentiment_join(spark, sf):
    j = jn.attach_sentiment(derive.bars(spark, sf).select("symbol", "date"), _daily(spark, sf))
    return rnd(fa.sentiment_factor(j, "sentiment_mean"))


@query("aligned_horizons", "JN4", f"""with {q.SCORES}, x as (select date, symbol, max(case when horizon = 5 then fwd_ret end) as a, max(case when horizon = 10 then fwd_ret end) as b, max(case when horizon = 20 then fwd_ret end) as c from scores group by 1, 2)
  select {q.D}, symbol, {q.rs(6, fwd_ret_5='a', fwd_ret_10='b', fwd_ret_20='c')} from x where a is not null and b is not null and c is not null""")
def aligned_horizons(spark, sf):
    return rnd(jn.align_horizons(derive.scores(derive.bars(spark, sf)), [5, 10, 20], "fwd_ret"))


@query("outer_date_alignment", "JN5", f"""with {q.BARS}, a as (select date, avg(close) as c from bars group by 1), o as (select cast(o_orderdate as date) as date, sum(o_totalprice) as v from orders group by 1)
  select {q.D}, {q.rs(4, mean_close='c', order_value='v')} from a full outer join o using (date)""")
def outer_date_alignment(spark, sf):
    a = derive.bars(spark, sf).groupBy("date").agg(F.avg("close").alias("mean_close"))
    o = derive.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("order_value"))
    return rnd(a.join(o, "date", "full_outer"), 4)


@query("common_dates", "JN6 SE3", f"with {q.HOUR}, d as (select ts from hour group by 1 having count(distinct symbol) = (select count(distinct symbol) from hour)) select cast(ts as varchar) as date from d where (select count(*) from d) >= 3")
def common_dates(spark, sf):
    return rnd(jn.common_dates(derive.hour_bars(spark, sf).withColumnRenamed("ts", "date")))


_click = "select user_id, ts, value, event_id from events where event_type = (select min(event_type) from events)"


@query("tolerant_asof", "JN7", f"""with {q.BARS}, g as (select distinct date from bars where symbol = 'Brand#1'), s as (select symbol, date as d0, close from bars where day(date) % 4 = 0)
  select b.symbol, cast(b.date as varchar) as date, cast(case when date_diff('day', s.d0, b.date) <= 3 then s.d0 end as varchar) as asof_date, {q.r("case when date_diff('day', s.d0, b.date) <= 3 then s.close end", 6, 'asof_close')}
  from bars b asof left join s on b.symbol = s.symbol and b.date >= s.d0""")
def tolerant_asof(spark, sf):
    b = derive.bars(spark, sf)
    sig = b.filter(F.dayofmonth("date") % 4 == 0).select("symbol", "date", "close")
    return rnd(jn.tolerant_match(b.select("symbol", "date"), sig, ["symbol"], "date", ["close"], 3))


@query("tick_asof_pooled", "JN1 JN7", f"""with r as ({_click}) select e.event_id, cast(r.ts as varchar) as asof_ts, {q.r('r.value', 6, 'asof_value')}, r.event_id as asof_ref from events e asof left join r on e.ts >= r.ts""")
def tick_asof_pooled(spark, sf):
    """Every tick joined to the latest tick of one type over the whole stream: a single group of any size."""
    e = derive.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    first = e.agg(F.min("event_type").alias("event_type"))
    r = e.join(F.broadcast(first), "event_type").select("ts", "value", F.col("event_id").alias("ref"))
    return rnd(jn.asof_join(e.select("event_id", "ts"), r, [], "ts", ["value", "ref"], tie="ref").drop("ts"))


@query("tick_asof_by_user", "JN1", f"""with r as ({_click}) select e.event_id, cast(r.ts as varchar) as asof_ts, {q.r('r.value', 6, 'asof_value')} from events e asof left join r on e.user_id = r.user_id and e.ts >= r.ts""")
def tick_asof_by_user(spark, sf):
    e = derive.table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    first = e.agg(F.min("event_type").alias("event_type"))
    r = e.join(F.broadcast(first), "event_type").select("user_id", "ts", "value")
    return rnd(jn.asof_join(e.select("event_id", "user_id", "ts"), r, ["user_id"], "ts", ["value"]).drop("ts", "user_id"))


_ver = """pos as (select symbol, date, close, row_number() over (partition by symbol order by date) as p from bars),
  verified as (select pr.*, e.close as exit_close, e.date as exit_date, e.close / latest_close - 1 as actual_return, e.close is not null as verified,
   case when e.close is not null then (p_up > 0.5 and e.close / latest_close - 1 > 0) or (p_up < 0.5 and e.close / latest_close - 1 < 0) end as hit
   from predictions pr left join pos s on s.symbol = pr.symbol and s.date = pr.latest_date left join pos e on e.symbol = pr.symbol and e.p = s.p + pr.horizon)"""
VERIFIED = q.PREDICTIONS + ", " + _ver


def verified(spark, sf):
    b = derive.bars(spark, sf)
    return jn.verify_predictions(derive.predictions(derive.scores(b)), b)


@query("verified_predictions", "JN8", f"with {VERIFIED} select symbol, horizon, cast(latest_date as varchar) as latest_date, cast(exit_date as varchar) as exit_date, verified::int as verified, hit::int as hit, {q.r('actual_return', 6, 'actual_return')} from verified")
def verified_predictions(spark, sf):
    v = verified(spark, sf)
    return rnd(v.select("symbol", "horizon", "latest_date", "exit_date", F.col("verified").cast("int").alias("verified"), F.col("hit").cast("int").alias("hit"), "actual_return"))


@query("verified_to_asof", "JN8", f"""with {q.PREDICTIONS}, l as (select symbol, arg_max(close, date) as c, max(date) as d from bars where date <= date '2000-06-30' group by 1),
  j as (select p.*, case when latest_date + horizon * interval 1 day <= date '2000-06-30' and d > latest_date then c end as exit_close from predictions p left join l using (symbol))
  select symbol, horizon, cast(latest_date as varchar) as latest_date, (exit_close is not null)::int as verified, {q.r('exit_close / latest_close - 1', 6, 'actual_return')} from j""")
def verified_to_asof(spark, sf):
    b = derive.bars(spark, sf)
    v = jn.verify_predictions(derive.predictions(derive.scores(b)), b, asof="2000-06-30", mode="to_asof")
    return rnd(v.select("symbol", "horizon", "latest_date", F.col("verified").cast("int").alias("verified"), "actual_return"))


_al = f"""a as (select *, row_number() over (partition by symbol order by date) - 1 as ia from bars), b as (select *, row_number() over (partition by symbol order by date) - 1 as ib from snapb),
  n as (select * from (select symbol, count(*) as na from bars group by 1) join (select symbol, count(*) as nb from snapb group by 1) using (symbol)),
  cand as (select distinct symbol, na, nb, shift from (select symbol, na, nb, 0 as shift from n union all select symbol, na, nb, nb - na + o as shift from n, range(-5, 6) t(o))),
  m as (select c.*, a.ia, abs(a.open - b.open) <= 1e-6 and abs(a.high - b.high) <= 1e-6 and abs(a.low - b.low) <= 1e-6 and abs(a.close - b.close) <= 1e-6 as eq,
     a.date as da, b.date as db, a.volume as va, b.volume as vb, a.close / b.close as rt from cand c join a on a.symbol = c.symbol join b on b.symbol = c.symbol and b.ib = a.ia + c.shift),
  g as (select symbol, shift, sum(case when ia >= least(na, nb - shift) - 60 and eq then 1 else 0 end) as tail_equal, count(*) as rows from m group by 1, 2),
  best as (select * from (select *, row_number() over (partition by symbol order by tail_equal desc, rows desc, abs(shift), shift) as k from g) where k = 1)"""


@query("snapshot_alignment", "JN9", f"with {q.BARS}, {q.SNAP_B}, {_al} select symbol, shift, tail_equal, rows from best")
def snapshot_alignment(spark, sf):
    b = derive.bars(spark, sf)
    return jn.best_alignment(b, derive.snapshot_b(b))


@query("snapshot_reconcile", "JN10 SRC12", f"""with {q.BARS}, {q.SNAP_B}, {_al}, r as (select m.symbol, any_value(m.shift) as shift, count(*) as aligned_rows, sum(eq::int) as equal_rows, avg((abs(va - vb) <= 1e-6)::int) as volume_rate,
   sum((eq and da <> db)::int) as label_mismatch, max(case when not eq then ia end) as lb, min(case when eq then ia end) as fo, stddev_pop(case when not eq then rt end) as rs from m join best on best.symbol = m.symbol and best.shift = m.shift group by 1)
  select symbol, shift, aligned_rows, equal_rows, label_mismatch, {q.r('volume_rate', 6, 'volume_rate')}, case when aligned_rows < 30 then 'unverifiable' when equal_rows = aligned_rows then 'replayable'
   when lb < fo and rs < 1e-6 then 'rescaled_history' when lb < fo then 'old_part_differs' else 'scattered' end as verdict from r""")
def snapshot_reconcile(spark, sf):
    b = derive.bars(spark, sf)
    return rnd(jn.reconcile(b, derive.snapshot_b(b)))


@query("forecast_positions", "JN11", f"""with {q.BARS}, act as (select symbol, arg_max(close, date) as lc, max(date) as ld from bars where date <= date '2000-12-31' group by 1),
  f as (select b.symbol, b.date, b.close as price, case when b.close / lc - 1 > 0.01 then 1 when b.close / lc - 1 < -0.01 then -1 end as s from bars b join act using (symbol) where b.date > ld)
  select symbol, {q.D}, {q.r('price', 6, 'price')}, coalesce(s, 0) as signal, coalesce(last_value(s ignore nulls) over ({q.W} rows between unbounded preceding and current row), 0) as position from f""")
def forecast_positions(spark, sf):
    b = derive.bars(spark, sf)
    act = b.filter(F.col("date") <= F.lit("2000-12-31").cast("date"))
    return rnd(jn.forecast_positions(act, b.select("symbol", "date", F.col("close").alias("price"))))


@query("missing_symbols", "JN12 SE4", "select c_custkey as symbol from customer except select user_id from events")
def missing_symbols(spark, sf):
    u = derive.table(spark, sf, "customer").select(F.col("c_custkey").alias("symbol"))
    h = derive.table(spark, sf, "events").select(F.col("user_id").alias("symbol"))
    return u.join(h, "symbol", "left_anti")
