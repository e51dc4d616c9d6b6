"""Selection and set queries (SO*, SE*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import selection as so
from panelspark.operators import pairs
from panelspark.operators import statistics as st
from panelspark.operators.windows import Series, rnd
from panelspark.plans import sqltext as q
from panelspark.plans.registry import query
from panelspark.sources import derive

TOP = """tq0 as (select *, count(*) over (partition by date) as n, row_number() over (partition by date order by p_up desc, symbol) as k from scores where horizon = 5),
  tq1 as (select * from tq0 where n >= 3 and k <= greatest(1, round_even(n * 0.3, 0))), tq as (select * from tq1 where symbol in (select symbol from tq1 group by 1 having count(*) >= 3))"""


def scores5(spark, sf):
    return derive.scores(derive.bars(spark, sf), horizons=(5,))


@query("top_quantile", "SO2", f"with {q.SCORES}, {TOP} select symbol, {q.D}, k as rank, {q.r('p_up', 6, 'p_up')} from tq")
def top_quantile(spark, sf):
    return rnd(so.top_quantile(scores5(spark, sf)).select("symbol", "date", "rank", "p_up"))


@query("latest_rows", "SO3", f"with {q.BARS} select symbol, cast(max(date) as varchar) as date, {q.rs(6, close='arg_max(close, date)', volume='arg_max(volume, date)')} from bars group by 1")
def latest_rows(spark, sf):
    return rnd(so.latest(derive.bars(spark, sf)).select("symbol", "date", "close", "volume"))


@query("random_subset_sizes", "SO7", f"with {q.SCORES}, {TOP}, k as (select date, count(*) as k from tq group by 1) select d as draw, {q.D}, k as n from k, range(0, 5) t(d)")
def random_subset_sizes(spark, sf):
    """Size of each hash-random control subset (the members differ from any SQL random order)."""
    s = scores5(spark, sf)
    k = so.top_quantile(s).groupBy("date").agg(F.count(F.lit(1)).alias("k"))
    return rnd(so.random_subset(s, k, 5).groupBy("draw", "date").agg(F.count_distinct("symbol").alias("n")))


@query("random_pools", "SO8", None)
def random_pools(spark, sf):
    return so.random_pools(derive.table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct(), 10, 12)


@query("selection_turnover", "SE5", f"""with {q.SCORES}, {TOP}, d as (select date, list(symbol) as s, row_number() over (order by date) as i from tq group by 1), p as (select *, lag(s) over (order by i) as prev from d)
  select {q.D}, len(list_distinct(list_concat(s, prev))) - len(list_intersect(s, prev)) as changed, {q.r('(len(list_distinct(list_concat(s, prev))) - len(list_intersect(s, prev)))::double / greatest(len(list_distinct(list_concat(s, prev))), 1)', 6, 'turnover')} from p where prev is not null""")
def selection_turnover(spark, sf):
    return rnd(so.selection_turnover(so.top_quantile(scores5(spark, sf))))


@query("merged_news", "SE6", """with u as (select text as title, source, timestamp '2024-01-01' + doc_id * interval 1 minute as ts from documents union all select text, source || '-b', timestamp '2024-01-01' + doc_id * interval 1 minute + interval 30 second from documents where source is not null),
  k as (select *, row_number() over (partition by title order by ts desc, source desc) as k from u) select sha256(title) as title_hash, source, cast(ts as varchar) as ts from k where k = 1""")
def merged_news(spark, sf):
    d = derive.table(spark, sf, "documents").select("doc_id", F.col("text").alias("title"), "source", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("ts"))
    a = d.drop("doc_id")
    b = d.filter("source is not null").select("title", F.concat("source", F.lit("-b")).alias("source"), (F.col("ts") + F.expr("interval 30 seconds")).alias("ts"))
    return rnd(so.merge_news([a, b]).select(F.sha2("title", 256).alias("title_hash"), "source", "ts"))


@query("best_candidates", "SO5", f"""with {q.SCORES}, ic as ({q.spearman('scores', 'symbol, horizon', 'p_up', 'fwd_ret')}), k as (select *, abs(ic) * sqrt(n) > 2 as sig, row_number() over (partition by symbol order by (abs(ic) * sqrt(n) > 2)::int desc, abs(ic) desc, horizon desc) as k from ic)
  select symbol, horizon as candidate, {q.r('ic', 6, 'ic')}, n, sig::int as significant from k where k = 1""")
def best_candidates(spark, sf):
    from panelspark.operators.order_stats import spearman

    ic = spearman(derive.scores(derive.bars(spark, sf)), ["symbol", "horizon"], "p_up", "fwd_ret", bounded=True)
    c = ic.select("symbol", F.col("horizon").alias("candidate"), "ic", "n", (F.abs("ic") * F.sqrt("n") > 2).cast("int").alias("significant"))
    return rnd(so.best_candidate(c, ["symbol"]))


RET = f"ret0 as (select symbol, date, close / {q.lag('close')} - 1 as ret from bars)"
PAIRS = RET + """, pairs as (select a.symbol as a, b.symbol as b, count(*) as n, corr(a.ret, b.ret) as rho from ret0 a join ret0 b on a.date = b.date and a.symbol < b.symbol where a.ret is not null and b.ret is not null group by 1, 2 having count(*) >= 60)"""


def returns(spark, sf):
    s = Series()
    return derive.bars(spark, sf).select("symbol", "date", s.pct("close").alias("ret"))


@query("pair_correlations", "ST21 SO4", f"with {q.BARS}, {PAIRS} select a, b, n, {q.r('rho', 6, 'rho')} from pairs")
def pair_correlations(spark, sf):
    p = st.pair_correlations(returns(spark, sf))
    return rnd(p)


@query("effective_dimension", "ST22", f"with {q.BARS}, {PAIRS}, k as (select count(distinct symbol) as m from bars) select m as n_symbols, {q.rs(6, mean_rho='avg(rho)', effective_dimension='m * m / (m + 2 * sum(rho * rho))')} from pairs, k group by m")
def effective_dimension(spark, sf):
    r = returns(spark, sf)
    return rnd(st.participation(st.pair_correlations(r), r))


@query("strong_pairs", "ST21 SO4", f"with {q.BARS}, {PAIRS} select a, b, n, {q.r('rho', 6, 'rho')} from pairs where abs(rho) >= 0.1 and not isnan(rho)")
def strong_pairs(spark, sf):
    """The synthetic returns are nearly independent, so the bound is low."""
    return rnd(pairs.strong_pairs(returns(spark, sf), 0.1))


@query("eigen_spectrum", "ST22", None)
def eigen_spectrum(spark, sf):
    """The three leading components of the returns, and of what the market leaves."""
    r = returns(spark, sf)
    return rnd(pairs.eigen_spectrum(r).withColumn("residual", F.lit(0)).unionByName(pairs.eigen_spectrum(r, residual=True).withColumn("residual", F.lit(1))))


@query("component_shares", "ST22", None)
def component_shares(spark, sf):
    h = derive.hour_bars(spark, sf)
    s = Series(order=("ts",))
    r = h.select("symbol", "ts", s.pct("close").alias("ret"))
    syms = ["click", "error", "purchase", "signup", "view"]
    wide = r.groupBy("ts").pivot("symbol").agg(F.first("ret"))
    return rnd(st.component_shares(wide, [c for c in wide.columns if c != "ts"]), 8)
