"""Projection, quality and scalar-function queries (PRJ*, SF*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import scalar as fx
from panelspark.operators import cleaning as cl
from panelspark.operators.windows import rnd
from panelspark.plans import sqltext as q
from panelspark.plans.registry import query
from panelspark.sources import derive

ASOF = "2002-01-01"


@query("filled_features", "PRJ3", f"""with {q.BARS}, {q.BAD}, x as (select symbol, date, case when volume is null then null else close / volume end as f, case when close > 0 then close end as g from bad qualify row_number() over (partition by symbol, date order by arrival) = 1)
  select symbol, {q.D}, {q.rs(6, f=f'coalesce(last_value(f ignore nulls) over ({q.W} rows between unbounded preceding and current row), 0.0)', g=f'coalesce(last_value(g ignore nulls) over ({q.W} rows between unbounded preceding and current row), 0.0)')} from x""")
def filled_features(spark, sf):
    b = cl.dedupe(derive.bad_bars(derive.bars(spark, sf)), order=("arrival",), keep="first")
    x = b.select("symbol", "date", F.when(F.col("volume").isNotNull(), F.col("close") / F.col("volume")).alias("f"),
                 F.when(F.col("close") > 0, F.col("close")).otherwise(F.lit(float("nan"))).alias("g"))
    return rnd(cl.fill_features(x, ["f", "g"]))


@query("aligned_features", "PRJ4", f"with {q.BARS} select symbol, {q.D}, {q.rs(6, close='close', absent='0.0::double', volume='volume')} from bars")
def aligned_features(spark, sf):
    return rnd(cl.align_features(derive.bars(spark, sf), ["close", "absent", "volume"]))


@query("feature_families", "PRJ2 PRJ5 PRJ6", """with f as (select distinct lower(replace(p_name, ' ', '_')) as a from part),
  g as (select (['ret_', 'macd', 'x_macd', 'boll_', 'my_rsi', 'ma_', 'ema_', 'aroon_', 'old_atr', 'hist_volume_ratio', 'obv', 'r1', 'doji', 'factor_', 'macro_', 'xvol', 'zz_', 'kama', 'trix'])[i] || a as feature from f, range(1, 20) t(i))
  select feature, case when feature like 'ret@_%' escape '@' then 'returns' when feature like 'boll@_%' escape '@' then 'boll' when feature like 'ma@_%' escape '@' then 'ma'
   when regexp_matches(feature, '^(ema|wma|dema|tema|trima)_') then 'trend_extra' when regexp_matches(feature, '^(kdj|stoch|aroon)_') then 'momentum' when feature like 'factor@_%' escape '@' then 'factor' when feature like 'macro@_%' escape '@' then 'macro'
   when feature like '%kama%' then 'kama' when feature like '%macd%' then 'macd' when feature like '%rsi%' then 'rsi' when regexp_matches(feature, 'adx|vortex_|trix') then 'trend_extra'
   when regexp_matches(feature, 'willr|roc|mom|cci|cmo|tsi') then 'momentum' when regexp_matches(feature, 'volatility|atr|stddev|mass_index|choppiness|boll_width') then 'volatility'
   when regexp_matches(feature, 'volume_ratio|obv|vwap|mfi|cmf|ad_line|pvt|nvi|force_index|eom') then 'volume' when regexp_matches(feature, 'pivot|r1|s1|r2|s2') then 'structure'
   when regexp_matches(feature, 'doji|hammer|engulfing|morning_star') then 'candle' else 'uncovered' end as family from g""")
def feature_families(spark, sf):
    p = derive.table(spark, sf, "part").select(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("a")).distinct()
    pre = ["ret_", "macd", "x_macd", "boll_", "my_rsi", "ma_", "ema_", "aroon_", "old_atr", "hist_volume_ratio", "obv", "r1", "doji", "factor_", "macro_", "xvol", "zz_", "kama", "trix"]
    g = p.select("a", F.explode(F.array(*[F.lit(x) for x in pre])).alias("x")).select(F.concat("x", "a").alias("feature"))
    return g.select("feature", cl.feature_family().alias("family"))


_cls = """u as (select p_partkey, upper(trim(raw_symbol)) as symbol from instruments), c as (select *, regexp_extract(symbol, '^([0-9A-Z]+)(\\.([A-Z]+))?$', 1) as code,
   regexp_extract(symbol, '^([0-9A-Z]+)(\\.([A-Z]+))?$', 3) as suf from u), cls as (select *, case when code = '' then 'unknown' when suf in ('SHF','DCE','CZC','INE','CFE','GFEX') then 'futures' when suf in ('FXCM','FX','FOREX') then 'forex'
   when suf <> '' and suf not in ('SH','SZ','BJ') then 'unknown' when regexp_matches(code, '^(51|56|58|159)') then 'etf' when regexp_matches(code, '^(60|68|00|30)') then 'stock'
   when regexp_matches(code, '^(11|12)') and length(code) = 6 then 'convertible' else 'unknown' end as asset_class,
   case when symbol like '%.FXCM' then 'forex' when regexp_matches(symbol, '\\.(SHF|INE|DCE|CZC|CFX)$') then 'futures' when regexp_matches(symbol, '^(51|52|56|58|15|16|159|588)') then 'etf'
   when regexp_matches(symbol, '\\.(SH|SZ)$') then 'stock' else 'other' end as pool from c)"""


def _classed(spark, sf):
    i = derive.instruments(spark, sf).select("p_partkey", fx.normalise_symbol("raw_symbol").alias("symbol"))
    return i.withColumns({"asset_class": fx.asset_class(), "pool": fx.coarse_class()})


@query("asset_classes", "PRJ7 PRJ9 SF1 SF2", f"with {q.INSTRUMENTS}, {_cls} select p_partkey, symbol, asset_class, pool, case when regexp_matches(symbol, '\\.(SH|SZ)$') then lower(right(symbol, 2)) || split_part(symbol, '.', 1) end as market_code, case when suf in ('SHF','DCE','CZC','INE','CFE','GFEX') then code || '0' end as contract from cls")
def asset_classes(spark, sf):
    return _classed(spark, sf).withColumns({"market_code": fx.market_code(), "contract": fx.continuous_contract()})


@query("class_groups", "PRJ8 JN12", f"""with {q.INSTRUMENTS}, {_cls}, o as (select symbol, 'override' as k from cls where p_partkey % 50 = 0)
  select coalesce(k, asset_class) as asset_class, count(*) as n, min(symbol) as first_symbol from cls left join o using (symbol) where coalesce(k, asset_class) <> 'unknown' group by 1""")
def class_groups(spark, sf):
    c = _classed(spark, sf)
    o = c.filter("p_partkey % 50 = 0").select("symbol", F.lit("override").alias("k"))
    g = c.join(o, "symbol", "left").withColumn("asset_class", F.coalesce("k", "asset_class")).filter("asset_class <> 'unknown'")
    return g.groupBy("asset_class").agg(F.count(F.lit(1)).alias("n"), F.min("symbol").alias("first_symbol"))


_qs = f"""qs as (select symbol, (avg((date is not null)::int) + avg((open is not null)::int) + avg((high is not null)::int) + avg((low is not null)::int) + avg((close is not null)::int) + avg((volume is not null)::int)) / 6 * 100 as completeness,
   (1 - avg((close < 0)::int) - avg((close = 0)::int) * 0.5) * 100 as accuracy, greatest(0.0, least(100.0, 100 - date_diff('day', max(date), date '{ASOF}') * 0.5)) as timeliness, count(*) as rows from bad group by 1),
  qq as (select *, (completeness + accuracy + timeliness + 100) / 4 as quality_score from qs)"""


@query("quality_scores", "PRJ10", f"with {q.BARS}, {q.BAD}, {_qs} select symbol, rows, {q.rs(6, completeness='completeness', accuracy='accuracy', timeliness='timeliness', quality_score='quality_score')}, case when quality_score >= 80 then 'A' else 'B' end as level from qq")
def quality_scores(spark, sf):
    return rnd(cl.quality_scores(derive.bad_bars(derive.bars(spark, sf)), ASOF).drop("compliance_score"))


@query("quality_filter", "PRJ11", f"with {q.BARS}, {q.BAD}, {_qs} select symbol, {q.D}, arrival, {q.r('close', 6, 'close')} from bad where symbol in (select symbol from qq where quality_score >= (select avg(quality_score) from qq))")
def quality_filter(spark, sf):
    b = derive.bad_bars(derive.bars(spark, sf))
    s = cl.quality_scores(b, ASOF)
    cut = s.agg(F.avg("quality_score").alias("cut"))
    good = s.join(F.broadcast(cut)).filter("quality_score >= cut")
    return rnd(cl.filter_by_quality(b, good, 0.0).select("symbol", "date", "arrival", "close"))


@query("pool_coverage", "PRJ13 RM11", f"""with {q.INSTRUMENTS}, {_cls}, have as (select distinct p.p_partkey from lineitem join part p on l_partkey = p.p_partkey)
  select asset_class, count(*) as configured, count(h.p_partkey) as present, count(*) - count(h.p_partkey) as missing, {q.r('count(h.p_partkey)::double / count(*)', 6, 'coverage')} from cls left join have h using (p_partkey) group by 1""")
def pool_coverage(spark, sf):
    u = _classed(spark, sf)
    have = derive.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("symbol"))
    return rnd(cl.pool_coverage(u.drop("symbol").withColumnRenamed("p_partkey", "symbol"), have))


@query("calendar_fields", "PRJ14", "select event_id, cast(extract(minute from ts) as int) as minute, cast(extract(hour from ts) as int) as hour, cast(extract(isodow from ts) as int) - 1 as weekday, cast(extract(day from ts) as int) as day, cast(extract(month from ts) as int) as month from events")
def calendar_fields(spark, sf):
    return cl.calendar_fields(derive.ticks(spark, sf).select("event_id", "ts")).drop("ts")


@query("filled_amount", "PRJ15", f"with {q.BARS}, {q.BAD} select symbol, {q.D}, arrival, {q.rs(4, volume='coalesce(volume, 0)', amount='coalesce(volume, 0) * (open + high + low + close) / 4')} from bad")
def filled_amount(spark, sf):
    return rnd(cl.fill_amount(derive.bad_bars(derive.bars(spark, sf))).select("symbol", "date", "arrival", "volume", "amount"), 4)


@query("window_normalised", "PRJ17", f"""with {q.BARS}, x as (select *, {q.avg('close', 60)} as m, {q.avg('close', 60, f='stddev_pop')} as s from bars)
  select symbol, {q.D}, {q.rs(6, close_norm='greatest(-5.0, least(5.0, (close - m) / nullif(s + 1e-5, 0)))', close_restored='greatest(-5.0, least(5.0, (close - m) / (s + 1e-5))) * (s + 1e-5) + m')} from x where m is not null""")
def window_normalised(spark, sf):
    d = cl.inverse_normalise(cl.window_normalise(derive.bars(spark, sf), ["close"], 60), "close")
    return rnd(d.filter("close_norm is not null").select("symbol", "date", "close_norm", "close_restored"))


@query("clamped_paths", "PRJ18", f"""with recursive {q.BARS}, b as (select *, row_number() over ({q.W}) as rn from bars), o as (select symbol, rn as origin, close as last_close from b where rn % 20 = 0),
  p as (select o.symbol, o.origin, o.last_close, b.rn - o.origin as step, b.close as price from o join b on b.symbol = o.symbol and b.rn between o.origin + 1 and o.origin + 8),
  c as (select symbol, origin, step, greatest(last_close * 0.9, least(last_close * 1.1, price)) as x from p where step = 1 union all
    select p.symbol, p.origin, p.step, greatest(c.x * 0.9, least(c.x * 1.1, p.price)) from c join p on p.symbol = c.symbol and p.origin = c.origin and p.step = c.step + 1)
  select symbol, origin, step, {q.r('x', 5, 'price')} from c""")
def clamped_paths(spark, sf):
    from panelspark.operators.forecast import rolling_origins

    return rnd(cl.clamp_path(rolling_origins(derive.bars(spark, sf), every=20, steps=8)), 5)


@query("business_days", "PRJ19", f"""with {q.BARS}, l as (select symbol, max(date) as d from bars group by 1), h as (select (select max(date) from bars) + cast(3 as integer) as hd),
  x as (select symbol, d, cast(d + cast(i as integer) as date) as day from l, range(1, 61) t(i)), y as (select *, row_number() over (partition by symbol order by day) as step from x where isodow(day) < 6 and day not in (select hd from h))
  select symbol, cast(day as varchar) as day, step from y where step <= 10""")
def business_days(spark, sf):
    b = derive.bars(spark, sf)
    last = b.groupBy("symbol").agg(F.max("date").alias("d"))
    hol = b.agg(F.date_add(F.max("date"), 3).alias("date"))
    return cl.business_days(last, "d", 10, hol).select("symbol", F.col("day").cast("string").alias("day"), "step")


_pos, _neg = derive.POSITIVE, derive.NEGATIVE
_hits = lambda ws: " + ".join(f"(contains(t, '{w}'))::int" for w in ws)


@query("text_sentiment", "SF3 SF4", f"""with {q.NEWS}, c as (select doc_id, regexp_replace(regexp_replace(trim(title), '[^一-龥a-zA-Z0-9]', ' ', 'g'), '\\s+', ' ', 'g') as t from news),
  h as (select doc_id, length(t) as n_clean, {_hits(_pos)} as p, {_hits(_neg)} as n from c)
  select doc_id, n_clean, {q.rs(6, sentiment='coalesce((p - n)::double / nullif(p + n, 0), 0.0)', positive_score='coalesce(p::double / nullif(p + n, 0), 0.0)', negative_score='coalesce(n::double / nullif(p + n, 0), 0.0)')} from h""")
def text_sentiment(spark, sf):
    n = derive.news(spark, sf)
    s = fx.lexicon_sentiment("title", _pos, _neg)
    return rnd(n.select("doc_id", fx.clean_length("title").alias("n_clean"), s.alias("s")).select("doc_id", "n_clean", "s.*"))


@query("score_functions", "SF5 SF6 SF7 SF8 SF15", f"""with {q.SCORES} select symbol, {q.D}, horizon, {q.rs(6, p_net='case when p_up >= 0.5 then p_up else 1 - (1 - p_up) end', confidence='2 * abs(p_up - 0.5)',
   interval_conf='greatest(0.0, least(1.0, 1 - (p_up * 0.2) / p_up))', score='greatest(-1.0, least(1.0, 2 * (p_up - 0.5)))', squashed='tanh(coalesce(fwd_ret, 0) * 10)', calibrated='1 / (1 + exp(-greatest(-30.0, least(30.0, 4 * (p_up - 0.5)))))',
   blend='case when fwd_ret is null then p_up else (0.7 * p_up + 0.3 * fwd_ret) end')} from scores""")
def score_functions(spark, sf):
    s = derive.scores(derive.bars(spark, sf))
    up = F.col("p_up") >= 0.5
    return rnd(s.select(
        "symbol", "date", "horizon", fx.net_up_probability(F.when(up, "up").otherwise("down"), F.when(up, F.col("p_up")).otherwise(1 - F.col("p_up"))).alias("p_net"),
        fx.confidence("p_up").alias("confidence"), fx.interval_confidence(F.col("p_up") * 0.9, F.col("p_up") * 1.1).alias("interval_conf"),
        fx.direction_score("p_up").alias("score"), fx.tanh_squash(F.col("fwd_ret") * 10).alias("squashed"), fx.logistic("p_up", 4.0, 0.5).alias("calibrated"),
        fx.weighted_blend({"p_up": 0.7, "fwd_ret": 0.3}).alias("blend")))


@query("normal_functions", "SF9", None)
def normal_functions(spark, sf):
    li = derive.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_quantity") - 25) / 5).alias("z"), (F.col("l_quantity") / 51).alias("p"))
    return rnd(li.select("l_orderkey", "l_linenumber", fx.normal_cdf("z").alias("cdf"), fx.normal_ppf("p").alias("ppf"), fx.two_sided_p("z").alias("p_two_sided")), 8)


@query("fingerprints", "SF10", """select o_orderkey, substr(sha256('{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}'), 1, 16) as fp from orders""")
def fingerprints(spark, sf):
    o = derive.table(spark, sf, "orders")
    m = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    return o.select("o_orderkey", fx.fingerprint(m).alias("fp"))


@query("session_predicates", "SF11 SF12 SF14 ST-R3", """select event_id, (isodow(ts) < 6 and (extract(hour from ts) * 60 + extract(minute from ts) between 570 and 690 or extract(hour from ts) * 60 + extract(minute from ts) between 780 and 900))::int as open,
  date_diff('day', cast(ts as date), date '2024-02-01') as age, json_extract_string(props, '$.k') as k from events""")
def session_predicates(spark, sf):
    t = derive.ticks(spark, sf)
    return t.select("event_id", fx.trading_hours("ts").cast("int").alias("open"), fx.age_days(F.to_date("ts"), "2024-02-01").alias("age"), fx.dig("props", "k").alias("k"))


@query("sql_functions", "UD5", f"""with {q.INSTRUMENTS} select p_partkey, upper(trim(raw_symbol)) as symbol, {q.rs(6, conf='2 * abs(p_partkey % 10 / 10.0 - 0.5)', up='1 - p_partkey % 10 / 10.0')} from instruments""")
def sql_functions(spark, sf):
    fx.register_sql(spark)
    i = derive.instruments(spark, sf).withColumn("p", F.col("p_partkey") % 10 / 10.0)
    return rnd(i.selectExpr("p_partkey", "panel_normalise_symbol(raw_symbol) as symbol", "panel_confidence(p) as conf", "panel_net_up('down', p) as up"))


@query("quality_classifier", "PRJ12", None)
def quality_classifier(spark, sf):
    from panelspark.operators.models import fit_quality_classifier

    d = derive.table(spark, sf, "documents").join(derive.table(spark, sf, "labels"), "doc_id")
    x = d.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.length(F.regexp_replace("text", r"\s", "")).cast("double").alias("dense"),
                 F.size(F.split("text", " ")).cast("double").alias("words"), F.col("quality").cast("double").alias("label"))
    return rnd(fit_quality_classifier(x, ["n_chars", "dense", "words"], "label").select("doc_id", "p_a", "quality_score", "level"))
