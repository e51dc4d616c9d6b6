"""Stream queries (ST-R*) run as batches over the same functions, plus real streams driven to completion."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelspark.operators import indicators as ti
from panelspark.operators.windows import rnd
from panelspark.plans import sqltext as q
from panelspark.plans.indicators import T0, _base
from panelspark.plans.registry import query
from panelspark.session import checkpoint_dir
from panelspark.sources import derive
from panelspark.streaming import bars as sb
from panelspark.streaming import quotes as sq

OHLCV = q.rs(6, open="open", high="high", low="low", close="close", volume="volume")
TK = "tk as (select event_id, event_type as symbol, ts, value as price from events)"


def ticks(spark, sf):
    return derive.ticks(spark, sf).select("symbol", "ts", "event_id", "price")


def _bars_sql(width, slide):
    return f"""with {TK}, w as (select symbol, event_id, ts, price, time_bucket(interval '{slide} minutes', ts) - k * interval '{slide} minutes' as start from tk, range(0, {width // slide}) x(k))
  select symbol, cast(start as varchar) as ts, {q.rs(6, open='first(price order by ts, event_id)', high='max(price)', low='min(price)', close='last(price order by ts, event_id)', volume='count(*)::double')} from w group by symbol, start"""


@query("tumbling_bars", "ST-R8", _bars_sql(60, 60))
def tumbling_bars(spark, sf):
    return rnd(sb.tumbling_bars(ticks(spark, sf)))


@query("sliding_bars", "ST-R8", _bars_sql(60, 30))
def sliding_bars(spark, sf):
    return rnd(sb.sliding_bars(ticks(spark, sf)))


@query("session_bars", "ST-R8", """with t as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts) < interval 20 minutes then 0 else 1 end as b from events), s as (select *, sum(b) over (partition by user_id order by ts) as sid from t)
  select user_id, cast(min(ts) as varchar) as ts, count(*) as n, """ + q.rs(6, high="max(value)", low="min(value)") + " from s group by user_id, sid")
def session_bars(spark, sf):
    t = derive.ticks(spark, sf).select("user_id", "ts", "price")
    return rnd(sb.session_bars(t, key="user_id").drop("end"))


@query("unique_snapshots", "ST-R10", f"select event_type as symbol, cast(date_trunc('minute', ts) as varchar) as ts, first(event_id order by events.ts, event_id) as event_id, {q.r('first(value order by events.ts, event_id)', 6, 'price')} from events group by event_type, date_trunc('minute', ts)")
def unique_snapshots(spark, sf):
    t = ticks(spark, sf).withColumn("at", F.col("ts")).withColumn("ts", F.date_trunc("minute", "ts"))
    return rnd(sb.unique_snapshots(t, order=("at", "event_id")).select("symbol", "ts", "event_id", "price"))


@query("change_pct", "ST-R2", f"select event_id, {q.r('value / (value + 1) - 1', 6, 'change_pct')} from events where event_id % 9 <> 0 and value > 0")
def change_pct(spark, sf):
    from panelspark.sources.quotes import parse_quotes

    return rnd(sq.change_pct(parse_quotes(derive.quote_lines(spark, sf))).select("event_id", "change_pct"))


@query("rolling_baseline", "ST-R4", f"""with {q.BARS}, {T0}, {_base}, n as (select symbol, max(date) as d, count(*) as n from bars group by 1)
  select b.symbol, cast(b.date as varchar) as base_date, {q.rs(5, base_close='close', ma_20_ratio='close / ma_20 - 1', volatility='volatility', rsi='100 - 100 / (1 + g / (l + 1e-9))')}, (n >= 30)::int as available from b2 b join n on n.symbol = b.symbol and n.d = b.date""")
def rolling_baseline(spark, sf):
    r = ti.rolling_features_tminus1(derive.bars(spark, sf))
    return rnd(r.select("symbol", "base_date", "base_close", "ma_20_ratio", "volatility", "rsi", F.col("available").cast("int").alias("available")), 5)


DS = """base as (select event_type as symbol, arg_max(value, (ts, event_id)) as bc, max(cast(ts as date)) as bd, avg(value) as m from events where ts < timestamp '2024-01-20' group by 1), ds as (select e.event_id, e.event_type as symbol, e.value / bc - 1 as move, cast(e.ts as date) - bd as age, case when bc > m then 'up' when bc < m then 'down' end as dir
   from events e join base on base.symbol = e.event_type where e.ts >= timestamp '2024-01-20'), dr as (select *, case when dir is null or age > 5 then 'unknown' when (dir = 'up' and move < -0.01) or (dir = 'down' and move > 0.01) then 'stale' else 'intact' end as drift from ds)"""


def drifted(spark, sf):
    t = ticks(spark, sf)
    cut = F.lit("2024-01-20").cast("timestamp")
    old = t.filter(F.col("ts") < cut).groupBy("symbol").agg(F.max_by("price", F.struct("ts", "event_id")).alias("base_close"), F.max(F.to_date("ts")).alias("base_date"), F.avg("price").alias("m"))
    base = old.withColumns({"direction": F.when(F.col("base_close") > F.col("m"), "up").when(F.col("base_close") < F.col("m"), "down"), "available": F.lit(True)}).drop("m")
    return sq.drift_state(t.filter(F.col("ts") >= cut), base)


@query("drift_states", "ST-R5 JN13", f"with {DS} select event_id, symbol, drift, {q.r('move', 6, 'move')} from dr")
def drift_states(spark, sf):
    return rnd(drifted(spark, sf).select("event_id", "symbol", "drift", "move"))


@query("poll_summary", "ST-R6", f"with {DS} select drift, count(*) as snapshots, count(distinct symbol) as symbols from dr group by 1")
def poll_summary(spark, sf):
    return sq.poll_summary(drifted(spark, sf))


def _run(stream, path, mode="append"):
    root = f"{path}/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck")
    w.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{root}/out")


@query("streamed_hour_bars", "ST-R6 ST-R7 ST-R8", f"""with {TK}, w as (select symbol, date_trunc('hour', ts) as start, ts, event_id, price from tk), f as (select max(ts) - interval 10 minutes as wm from tk)
  select symbol, cast(start as varchar) as ts, {q.rs(6, open='first(price order by ts, event_id)', high='max(price)', low='min(price)', close='last(price order by ts, event_id)', volume='count(*)::double')} from w, f where start + interval 1 hour <= wm group by symbol, start""")
def streamed_hour_bars(spark, sf):
    """A real stream over the events file: watermark, append mode, parquet sink with checkpoint; open windows stay out."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    t = s.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))
    return rnd(_run(sb.tumbling_bars(t), checkpoint_dir(spark)))


@query("streamed_running_average", "ST-R9", None)
def streamed_running_average(spark, sf):
    """Keyed state over a stream (RocksDB): exponential average per symbol, continued across micro-batches."""
    from panelspark.streaming.state import running_average

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = spark.read.parquet(f"{sf}/events.parquet").schema
        s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        t = s.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))
        return rnd(_run(running_average(t), checkpoint_dir(spark)))
    finally:
        spark.conf.set(key, before)
