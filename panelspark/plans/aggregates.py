"""Aggregation queries (AG*, RM1, RM15, RM17, RM18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import aggregates as ag
from panelspark.operators.indicators import S
from panelspark.operators.windows import rnd
from panelspark.plans import sqltext as q
from panelspark.plans.joins import IND, VERIFIED, verified
from panelspark.plans.registry import query
from panelspark.sources import derive

SAMPLES = VERIFIED + ", samples as (select *, hit::int as h from verified where verified and p_up is not null)"
EDGES, GRID = [0.0, 0.1, 0.2, 0.4, 0.6, 1.0], [0.0, 0.1, 0.2, 0.3, 0.5, 0.9]


def samples(spark, sf):
    """Verified records only, confidence falling back to 2|p - 0.5|."""
    v = verified(spark, sf).filter(F.col("verified") & F.col("p_up").isNotNull())
    return v.withColumn("confidence", F.coalesce("confidence", 2 * F.abs(F.col("p_up") - 0.5)))


@query("verified_samples", "RM1", f"with {SAMPLES} select symbol, horizon, cast(latest_date as varchar) as latest_date, h as hit, {q.rs(6, confidence='confidence', actual_return='actual_return')} from samples")
def verified_samples(spark, sf):
    return rnd(samples(spark, sf).select("symbol", "horizon", "latest_date", F.col("hit").cast("int").alias("hit"), "confidence", "actual_return"))


@query("audit_report", "AG4 RM17", f"""with {VERIFIED}, g as (select horizon, symbol, count(*) as records, sum(verified::int) as verified, sum(coalesce(hit::int, 0) * verified::int) as hits,
   sum(verified::int * (date_diff('day', latest_date, date '2001-10-31') <= 30)::int) as recent, sum(coalesce(hit::int, 0) * verified::int * (date_diff('day', latest_date, date '2001-10-31') <= 30)::int) as recent_hits
   from verified group by grouping sets ((), (horizon), (symbol)))
  select horizon, symbol, records, verified, hits, recent, recent_hits, {q.rs(6, hit_rate='hits::double / nullif(verified, 0)', recent_hit_rate='recent_hits::double / nullif(recent, 0)')},
   coalesce((hits::double / nullif(verified, 0) - recent_hits::double / nullif(recent, 0) > 0.1)::int, 0) as drift from g""")
def audit_report(spark, sf):
    return rnd(ag.audit_report(verified(spark, sf), "2001-10-31"))


_bin = "case " + " ".join(f"when confidence >= {EDGES[i]} and confidence {'<=' if i == 4 else '<'} {EDGES[i + 1]} then {i}" for i in range(5)) + " end"


@query("confidence_bins", "AG5", f"""with {SAMPLES}, g as (select horizon, {_bin} as bin, count(*) as samples, avg(h) as hr, avg(actual_return) as mr, avg(abs(actual_return)) as ma from samples group by 1, 2),
   t as (select horizon, count(*) as n from samples group by 1), f as (select horizon, n, i as bin from t, range(0, 5) r(i))
  select horizon, f.bin, {q.r(str(EDGES) + '[f.bin + 1]', 6, 'lo')}, coalesce(samples, 0) as samples, {q.r('coalesce(samples, 0)::double / n', 6, 'coverage')}, coalesce(samples, 0) >= 5 as available,
   {q.rs(6, hit_rate='case when samples >= 5 then hr end', mean_return='case when samples >= 5 then mr end', mean_abs_return='case when samples >= 5 then ma end')} from f left join g using (horizon, bin)""")
def confidence_bins(spark, sf):
    return rnd(ag.confidence_bins(samples(spark, sf), EDGES, ["horizon"]))


_thr = f"thr(threshold) as (values {', '.join(f'({t}::double)' for t in GRID)})"
_scan = """scan as (select horizon, threshold, sum((confidence >= threshold)::int) as n, count(*) as total, avg(case when confidence >= threshold then h end) as hr,
   avg(case when confidence >= threshold then actual_return end) as mr from samples, thr group by 1, 2)"""


@query("threshold_scan", "AG6", f"with {SAMPLES}, {_thr}, {_scan} select horizon, {q.r('threshold', 6, 'threshold')}, n as samples, {q.r('n::double / total', 6, 'coverage')}, n >= 5 as available, {q.rs(6, hit_rate='case when n >= 5 then hr end', mean_return='case when n >= 5 then mr end')} from scan")
def threshold_scan(spark, sf):
    return rnd(ag.threshold_scan(samples(spark, sf), GRID, ["horizon"]))


@query("decision_verdict", "AG7", f"""with {SAMPLES}, g as (select horizon, count(*) as n_total, sum((confidence >= 0.2)::int) as n_subset, avg(case when confidence >= 0.2 then h end) as sh, avg(case when confidence >= 0.2 then actual_return end) as sr, avg(actual_return) as br from samples group by 1)
  select horizon, n_total, n_subset, {q.rs(6, subset_hit_rate='sh', subset_mean_return='sr', baseline_mean_return='br')}, case when n_total < 30 or n_subset < 5 then 'insufficient' when sh > 0.5 and sr > br then 'effective' else 'ineffective' end as status from g""")
def decision_verdict(spark, sf):
    return rnd(ag.decision_verdict(samples(spark, sf), 0.2, ["horizon"]))


_state = "st as (select s.*, 2 * (p_up - 0.5) as score, case when close > avg(close) over (partition by symbol, horizon order by date rows between 59 preceding and current row) then 'above' else 'below' end as state from scores s)"


def state_scores(spark, sf):
    from panelspark.operators.windows import Series

    w = Series(keys=("symbol", "horizon"))
    s = derive.scores(derive.bars(spark, sf)).withColumn("score", 2 * (F.col("p_up") - 0.5))
    return s.withColumn("state", F.when(F.col("close") > F.avg("close").over(w.frame(60)), "above").otherwise("below"))


@query("stratified_by_state", "AG8", f"""with {q.SCORES}, {_state}, ic as ({q.spearman("st", "horizon, state", "score", "fwd_ret")}), g as (select horizon, state, count(*) as samples,
   avg(case when fwd_ret <> 0 and score <> 0 then (sign(score) = sign(fwd_ret))::int end) as hr, avg(((score > 0) = (fwd_ret > 0))::int) as acc from st where fwd_ret is not null group by 1, 2)
  select horizon, state, samples, {q.rs(6, ic='ic', hit_rate='hr', accuracy='acc')} from g join ic using (horizon, state)""")
def stratified_by_state(spark, sf):
    return rnd(ag.stratified(state_scores(spark, sf), "state", ["horizon"]))


@query("volatility_bands", "AG9", f"""with {SAMPLES}, v0 as (select symbol, date, close / {q.lag('close')} - 1 as r from bars), v as (select symbol, date as latest_date, {q.sd('r', 20)} as vol from v0),
   x as (select s.*, vol from samples s join v using (symbol, latest_date) where confidence >= 0.2 and vol is not null and actual_return is not null), c as (select horizon, quantile_cont(vol, [1/3.0::double, 2/3.0::double]) as k from x group by 1)
  select horizon, case when vol <= k[1] then 'low' when vol <= k[2] then 'mid' else 'high' end as band, count(*) as samples, {q.rs(6, hit_rate='avg(h)', mean_return='avg(actual_return)')} from x join c using (horizon) group by 1, 2""")
def volatility_bands(spark, sf):
    b = derive.bars(spark, sf).withColumn("r", S.pct("close"))
    v = b.select("symbol", F.col("date").alias("latest_date"), S.std("r", 20).alias("vol"))
    return rnd(ag.volatility_bands(samples(spark, sf).join(v, ["symbol", "latest_date"]), 0.2))


PERF = SAMPLES + ", perf as (select horizon, exit_date as date, avg(h) as accuracy from samples group by 1, 2)"


def perf(spark, sf):
    return samples(spark, sf).groupBy("horizon", F.col("exit_date").alias("date")).agg(F.avg(F.col("hit").cast("double")).alias("accuracy"))


@query("performance_history", "AG12", f"with {PERF} select horizon, count(*) as n, {q.rs(6, avg_accuracy='avg(accuracy)', min_accuracy='min(accuracy)', max_accuracy='max(accuracy)')} from perf where date > date '2000-12-31' - interval 30 day group by 1")
def performance_history(spark, sf):
    return rnd(ag.performance_history(perf(spark, sf), "2000-12-31"))


@query("accuracy_drift", "AG13 RM17", f"""with {PERF}, k as (select *, row_number() over (partition by horizon order by date desc) as k from perf where date > date '2000-12-31' - interval 30 day),
  g as (select horizon, avg(case when k <= 3 then accuracy end) as a, avg(case when k > 3 then accuracy end) as b from k group by 1) select horizon, {q.rs(6, recent='a', earlier='b')}, coalesce((abs(a - b) > 0.05)::int, 0) as drift from g""")
def accuracy_drift(spark, sf):
    return rnd(ag.accuracy_drift(perf(spark, sf), "2000-12-31"))


@query("trial_counts", "AG14 SRC17", "select o_orderpriority as command, count(*) as trials, count(distinct o_orderstatus || '|' || o_custkey) as distinct_trials from orders where cast(o_orderdate as date) <= date '1998-06-30' group by rollup (o_orderpriority)")
def trial_counts(spark, sf):
    o = derive.table(spark, sf, "orders")
    return ag.trial_counts(o.select(F.col("o_orderpriority").alias("command"), F.to_date("o_orderdate").alias("date"), F.concat_ws("|", "o_orderstatus", "o_custkey").alias("fingerprint")), "1998-06-30")


@query("stream_status", "AG15", "select count(distinct event_type) as symbols, count(*) as snapshots, cast(date_trunc('second', max(ts)) as varchar) as last_ts, date_diff('second', date_trunc('second', max(ts)), timestamp '2024-02-01') as age_seconds from events")
def stream_status(spark, sf):
    t = derive.ticks(spark, sf).select("symbol", F.date_trunc("second", "ts").alias("ts"))
    return rnd(ag.stream_status(t, "2024-02-01"))


CONTRIB = f"""ct as (unpivot (select symbol, date, case when cast(right(symbol, 1) as int) < 3 then 'a' when cast(right(symbol, 1) as int) < 7 then 'b' else 'c' end as state,
   close / {q.avg('close', 5)} - 1 as ma_gap, close / open - 1 as body, volume / 100 as vol, (high - low) / close as range_ from bars) on ma_gap, body, vol, range_ into name feature value contrib)"""


def contributions(spark, sf):
    """Per-row contributions of four features, standing in for model attributions."""
    n = F.right("symbol", F.lit(1)).cast("int")
    b = derive.bars(spark, sf).select(
        "symbol", "date", F.when(n < 3, "a").when(n < 7, "b").otherwise("c").alias("state"), (F.col("close") / S.mean("close", 5) - 1).alias("ma_gap"),
        (F.col("close") / F.col("open") - 1).alias("body"), (F.col("volume") / 100).alias("vol"), ((F.col("high") - F.col("low")) / F.col("close")).alias("range_"))
    return b.unpivot(["symbol", "date", "state"], ["ma_gap", "body", "vol", "range_"], "feature", "contrib").filter("contrib is not null")


@query("attribution_importance", "AG16", f"with {q.BARS}, {CONTRIB}, g as (select feature, avg(abs(contrib)) as i from ct group by 1) select feature, {q.rs(6, importance='i', share='i / sum(i) over ()')} from g")
def attribution_importance(spark, sf):
    return rnd(ag.importance(contributions(spark, sf)))


@query("attribution_drift", "AG17", f"""with {q.BARS}, {CONTRIB}, g as (select feature, avg(case when date < date '1999-01-01' then abs(contrib) end) as early, avg(case when date >= date '1999-01-01' then abs(contrib) end) as late from ct group by 1),
  h as (select *, row_number() over (order by early desc, feature) as early_rank, row_number() over (order by late desc, feature) as late_rank from g)
  select feature, {q.rs(6, early='early', late='late')}, early_rank, late_rank, early_rank - late_rank as shift, (row_number() over (order by abs(early_rank - late_rank) desc, feature) <= 2)::int as top from h""")
def attribution_drift(spark, sf):
    return rnd(ag.importance_drift(contributions(spark, sf), "1999-01-01", top=2))


@query("attribution_by_state", "AG18", f"with {q.BARS}, {CONTRIB}, g as (select state, feature, avg(abs(contrib)) as i from ct group by 1, 2), h as (select *, row_number() over (partition by state order by i desc, feature) as rank from g) select state, feature, {q.r('i', 6, 'importance')}, rank from h where rank <= 3")
def attribution_by_state(spark, sf):
    return rnd(ag.importance_by_state(contributions(spark, sf)))


@query("direction_consistency", "AG19", f"""with {q.SCORES}, d as (select symbol, date, case when fwd_ret > 0.05 then 'up' when fwd_ret < -0.05 then 'down' else 'flat' end as direction from scores where fwd_ret is not null),
  g as (select symbol, date, count(*) as n, string_agg(distinct direction, ',' order by direction) as directions from d group by 1, 2)
  select symbol, {q.D}, n, directions, case when directions like 'down%up' then 'conflict' when not contains(directions, ',') then 'consistent' else 'partial' end as status from g""")
def direction_consistency(spark, sf):
    s = derive.scores(derive.bars(spark, sf)).filter("fwd_ret is not null")
    d = s.select("symbol", "date", F.when(F.col("fwd_ret") > 0.05, "up").when(F.col("fwd_ret") < -0.05, "down").otherwise("flat").alias("direction"))
    return rnd(ag.direction_consistency(d, ["symbol", "date"]))


@query("macro_health", "AG22", f"""with {q.MACRO}, e as (select unnest({IND + ['6-NONE']}) as indicator), g as (select indicator, count(*) as n, max(date) as d from macro group by 1)
  select indicator, coalesce(n, 0) as n, cast(d as varchar) as last_date, case when n is null then 'missing' when date_diff('day', d, date '2002-06-30') > 120 then 'stale' else 'ok' end as status from e left join g using (indicator)""")
def macro_health(spark, sf):
    e = derive.table(spark, sf, "orders").select(F.explode(F.array(*[F.lit(i) for i in IND + ["6-NONE"]])).alias("indicator")).distinct()
    return rnd(ag.series_health(derive.macro(spark, sf), e, "2002-06-30"))


@query("tag_contrast", "RM15", f"with {SAMPLES} select horizon, day(latest_date) % 6 = 0 as tagged, count(*) as samples, {q.rs(6, hit_rate='avg(case when actual_return <> 0 then h end)', mean_return='avg(actual_return)')} from samples group by 1, 2")
def tag_contrast(spark, sf):
    s = samples(spark, sf).withColumn("tagged", F.dayofmonth("latest_date") % 6 == 0)
    return rnd(s.groupBy("horizon", "tagged").agg(F.count(F.lit(1)).alias("samples"), F.avg(F.when(F.col("actual_return") != 0, F.col("hit").cast("double"))).alias("hit_rate"),
                                                  F.avg("actual_return").alias("mean_return")))


@query("market_overview", "RM18", f"with {q.BARS}, r as (select date, close / {q.lag('close')} - 1 as r from bars) select {q.D}, count(r) as n, sum((r > 0)::int) as up, sum((r < 0)::int) as down, {q.rs(6, mean_ret='avg(r)', best='max(r)', worst='min(r)')} from r where r is not null group by date")
def market_overview(spark, sf):
    r = derive.bars(spark, sf).select("date", S.pct("close").alias("r")).filter("r is not null")
    return rnd(r.groupBy("date").agg(F.count("r").alias("n"), F.sum((F.col("r") > 0).cast("int")).alias("up"), F.sum((F.col("r") < 0).cast("int")).alias("down"),
                                     F.avg("r").alias("mean_ret"), F.max("r").alias("best"), F.min("r").alias("worst")))
