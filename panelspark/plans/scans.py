"""Source and sink queries (SRC*, PRJ16) on derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import scalar as fx
from panelspark.operators import cleaning as cl
from panelspark.operators.windows import rnd
from panelspark.plans import sqltext as q
from panelspark.plans.registry import query
from panelspark.sources import derive, quotes, readers

OHLCV = q.rs(6, open="open", high="high", low="low", close="close", volume="volume")


@query("clean_bars_first", "SRC1 SRC5 SO9", f"""with {q.BARS}, {q.BAD} select symbol, {q.D}, {OHLCV} from (select *, row_number() over (partition by symbol, date order by arrival) as k
  from bad where close > 0 and high > 0 and low > 0 and high >= low) where k = 1""")
def clean_bars_first(spark, sf):
    return rnd(cl.clean_bars(derive.bad_bars(derive.bars(spark, sf))).drop("arrival"))


@query("clean_bars_last", "SRC5 SO9", f"""with {q.BARS}, {q.BAD} select symbol, {q.D}, {OHLCV} from (select *, row_number() over (partition by symbol, date order by arrival desc) as k
  from bad where close > 0 and high > 0 and low > 0 and high >= low) where k = 1""")
def clean_bars_last(spark, sf):
    return rnd(cl.clean_bars(derive.bad_bars(derive.bars(spark, sf)), keep="last").drop("arrival"))


@query("pool_load", "SRC2 PRJ1", f"""with {q.BARS}, w as (select * from bars where date between date '1996-01-01' and date '1999-12-31')
  select symbol, {q.D}, {OHLCV} from w where symbol in (select symbol from w group by 1 having count(*) >= 300)""")
def pool_load(spark, sf):
    return rnd(cl.min_rows(cl.clip_window(derive.bars(spark, sf), "1996-01-01", "1999-12-31"), 300))


@query("source_fallback", "SRC3", f"""with {q.BARS}, s0 as (select * from bars where cast(right(symbol, 1) as int) % 2 = 0), s1 as (select symbol, date, close + 5 as close from bars where cast(right(symbol, 1) as int) % 3 < 2),
  u as (select symbol, date, close, 0 as priority from s0 union all select symbol, date, close, 1 from s1 union all select symbol, date, close, 2 from bars)
  select symbol, {q.D}, {q.r('close', 6, 'close')}, priority from u where priority = (select min(priority) from u v where v.symbol = u.symbol)""")
def source_fallback(spark, sf):
    b = derive.bars(spark, sf).select("symbol", "date", "close")
    n = F.right("symbol", F.lit(1)).cast("int")
    return rnd(cl.coalesce_sources([b.filter(n % 2 == 0), b.filter(n % 3 < 2).withColumn("close", F.col("close") + 5), b]))


@query("header_normalisation", "SRC4", f"""with {q.BARS} select symbol, {q.D}, {q.r("close", 6, "close")},
  {q.r("case when max(case when right(symbol, 1) = '3' then 0.0 else volume end) over (partition by symbol) <= 0 then 1.0 else volume end", 6, "volume")} from bars""")
def header_normalisation(spark, sf):
    b = derive.bars(spark, sf)
    raw = b.select("symbol", F.col("date").cast("string").alias("日期"), F.col("close").cast("string").alias("收盘"),
                   F.when(F.right("symbol", F.lit(1)) == "3", "0").otherwise(F.col("volume").cast("string")).alias("成交量"))
    return rnd(cl.normalise_headers(raw).select("symbol", "date", "close", "volume"))


@query("array_row_payload", "SRC6 SRC7", f"""with {q.BARS} select symbol, {q.D}, {OHLCV} from bars""")
def array_row_payload(spark, sf):
    """Bars packed into one JSON page per symbol and month, then parsed back."""
    b = derive.bars(spark, sf)
    row = F.array(*[F.col(c).cast("string") for c in ("date", "open", "close", "high", "low", "volume")])
    pages = b.groupBy("symbol", F.trunc("date", "month").alias("page")).agg(F.to_json(F.collect_list(row)).alias("payload"))
    return rnd(quotes.parse_array_rows(pages.drop("page")))


@query("quote_lines", "SRC8 ST-R1", f"""select event_id, cast(ts as varchar) as ts, 'sh' || user_id as code, {q.rs(6, price='value', prev_close='value + 1', open='value', high='value', low='value', volume='100.0::double')}
  from events where event_id % 9 <> 0 and value > 0 and value + 1 > 0""")
def quote_lines(spark, sf):
    return rnd(quotes.parse_quotes(derive.quote_lines(spark, sf)))


@query("macro_series", "SRC9", f"with {q.MACRO} select indicator, {q.D}, {q.r('value', 4, 'value')} from macro")
def macro_series(spark, sf):
    return rnd(derive.macro(spark, sf), 4)


@query("snapshot_log", "SRC10 SF13", f"""select event_id, event_type as symbol, cast(json_extract(props, '$.k') as bigint) as k, {q.r('value', 6, 'price')} from events where event_id % 10 <> 0""")
def snapshot_log(spark, sf):
    """Events as JSON lines with every tenth one cut short; corrupt lines are skipped on read."""
    e = derive.table(spark, sf, "events")
    line = F.to_json(F.struct("event_id", F.col("event_type").alias("symbol"), F.col("value").alias("price"), "props"))
    raw = e.select(F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 12)).otherwise(line).alias("line"))
    d = fx.decode_lines(raw, "line", "event_id bigint, symbol string, price double, props string")
    return rnd(d.select("event_id", "symbol", fx.dig("props", "k").cast("bigint").alias("k"), "price"))


@query("retention", "SRC11", "select cast(cast(ts as date) as varchar) as day, count(*) as n from events where cast(ts as date) >= date '2024-01-31' - interval 7 day group by 1")
def retention(spark, sf):
    e = derive.table(spark, sf, "events").select(F.to_date("ts").alias("day"))
    return readers.retained(e, "2024-01-31", 7).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("column_store", "SRC13 SE2", f"""with {q.BARS}, cal as (select date, row_number() over (order by date) - 1 as ordinal from (select distinct date from bars))
  select symbol, ordinal, field, {q.r('value', 6, 'value')} from (unpivot (select symbol, ordinal, open, high, low, close, volume from bars join cal using (date))
  on open, high, low, close, volume into name field value value)""")
def column_store(spark, sf):
    return rnd(readers.column_store(derive.bars(spark, sf))[0])


@query("column_store_ranges", "SRC13", f"with {q.BARS} select symbol, cast(min(date) as varchar) as start, cast(max(date) as varchar) as end from bars group by 1")
def column_store_ranges(spark, sf):
    return rnd(readers.column_store(derive.bars(spark, sf))[2])


@query("standardised_bars", "SRC14", f"""with {q.BARS}, {q.BAD}, p as (select * from bad where open > 0 and high > 0 and low > 0 and close > 0 and volume >= 0)
  select symbol, {q.D}, arrival, {OHLCV}, 1.0::double as factor from p where symbol in (select symbol from p group by 1 having count(*) >= 60)""")
def standardised_bars(spark, sf):
    return rnd(readers.standardise(derive.bad_bars(derive.bars(spark, sf))))


@query("seed_payload", "SRC16", f"""with {q.BARS} select symbol, {q.rs(6, open='arg_max(open, date)', high='arg_max(high, date)', low='arg_max(low, date)', close='arg_max(close, date)', volume='arg_max(volume, date)')}, 5 as n_keys from bars group by 1""")
def seed_payload(spark, sf):
    cols = ["open", "high", "low", "close", "volume"]
    last = derive.bars(spark, sf).groupBy("symbol").agg(F.max_by(F.struct(*cols), "date").alias("z")).select("symbol", "z.*")
    p = readers.seed_payload(last, cols)
    return rnd(p.withColumn("n_keys", F.size(F.json_object_keys("payload")).cast("long")).drop("payload"))


@query("open_repair", "PRJ16", f"""with {q.BARS}, x as (select symbol, date, case when day(date) % 3 = 0 then null else open end as open, close, volume from bars)
  select symbol, {q.D}, {q.rs(6, open=f"coalesce(open, {q.lag('close')}, close)", close='close', amount='close * volume')} from x""")
def open_repair(spark, sf):
    b = derive.bars(spark, sf)
    raw = b.select("symbol", "date", F.when(F.dayofmonth("date") % 3 == 0, "0").otherwise(F.col("open").cast("string")).alias("open"),
                   F.col("high"), F.col("low"), F.regexp_replace(F.col("close").cast("string"), r"^(\d)(\d{3}\.)", "$1,$2").alias("close"), "volume",
                   F.lit(None).cast("string").alias("amount"))
    return rnd(cl.repair_open(raw).select("symbol", "date", "open", "close", "amount"))


@query("fresh_source", "RM19", f"select o_orderpriority, count(*) as n, {q.r('sum(o_totalprice)', 2, 'total')} from orders group by 1")
def fresh_source(spark, sf):
    """Cached files younger than the time to live, by file modification time (here the whole orders table is fresh)."""
    o = readers.fresh_files(spark, f"{sf}/orders.parquet", 3600, "2000-01-01 00:00:00")
    return rnd(o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)
