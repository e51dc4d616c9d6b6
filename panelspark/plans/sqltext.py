"""Shared SQL fragments of the oracle texts."""

from __future__ import annotations

PX = "l_extendedprice / l_quantity"
KEY = "(l_orderkey * 8 + l_linenumber) * 1048576 + (l_partkey * 8191 + l_suppkey) % 1048576"

BARS = f"""bars as (
  select p_brand as symbol, cast(l_shipdate as date) as date,
    first({PX} order by {KEY}) as open, max({PX}) as high, min({PX}) as low,
    last({PX} order by {KEY}) as close, sum(l_quantity) as volume
  from lineitem join part on l_partkey = p_partkey group by 1, 2)"""

HOUR = """hour as (
  select event_type as symbol, date_trunc('hour', ts) as ts, first(value order by event_id) as open, max(value) as high,
    min(value) as low, last(value order by event_id) as close, cast(count(*) as double) as volume
  from events group by 1, 2)"""

MACRO = """macro as (
  select o_orderpriority as indicator, last_day(o_orderdate) as date, round(sum(o_totalprice), 2) as value
  from orders group by 1, 2)"""

NEWS = """news as (
  select doc_id, cast(date '1996-01-01' + cast(doc_id % 97 as integer) as date) as date, text as title, source
  from documents)"""

D = "cast(date as varchar) as date"
TS = "cast(ts as varchar) as ts"
W = "partition by symbol order by date"


def r(expr: str, digits: int = 6, name: str | None = None) -> str:
    """Rounded value with NaN/inf as null and no negative zero."""
    scale = "1" + "0" * digits + ".0::double"
    x = f"(case when isfinite(({expr})) then floor(({expr}) * {scale} + 0.70710678::double) / {scale} end)"
    return f"{x} as {name}" if name else x


def rs(digits: int = 6, **named: str) -> str:
    return ", ".join(r(e, digits, n) for n, e in named.items())


def avg(c: str, n: int, m: int | None = None, w: str = W, f: str = "avg") -> str:
    """Trailing aggregate over ``n`` rows, null under ``m`` values."""
    fr = f"over ({w} rows between {n - 1} preceding and current row)"
    return f"(case when count({c}) {fr} >= {n if m is None else m} then {f}({c}) {fr} end)"


def sd(c: str, n: int, m: int | None = None, w: str = W) -> str:
    return avg(c, n, m, w, "stddev_samp")


def mx(c: str, n: int, m: int | None = None, w: str = W) -> str:
    return avg(c, n, m, w, "max")


def mn(c: str, n: int, m: int | None = None, w: str = W) -> str:
    return avg(c, n, m, w, "min")


def sm(c: str, n: int, m: int | None = None, w: str = W) -> str:
    return avg(c, n, m, w, "sum")


def lag(c: str, n: int = 1, w: str = W) -> str:
    return f"lag({c}, {n}) over ({w})"


def lead(c: str, n: int = 1, w: str = W) -> str:
    return f"lead({c}, {n}) over ({w})"


SCORES = BARS + f""", sc0 as (
  select symbol, date, close, close / {avg('close', 20)} - 1 as rr, {lead('close', 5)} / close - 1 as f5,
    {lead('close', 10)} / close - 1 as f10, {lead('close', 20)} / close - 1 as f20 from bars),
scores as (
  select symbol, date, close, h.horizon, 1 / (1 + exp(-10 * rr)) as p_up,
    case h.horizon when 5 then f5 when 10 then f10 else f20 end as fwd_ret
  from sc0, (values (5), (10), (20)) h(horizon) where rr is not null)"""

PREDICTIONS = SCORES + """, predictions as (
  select symbol, horizon, date as latest_date, close as latest_close, p_up, 2 * abs(p_up - 0.5) as confidence
  from (select *, row_number() over (partition by symbol, horizon order by date) as rn from scores) where (rn - 1) % 5 = 0)"""


def spearman(source: str, keys: str, x: str, y: str, out: str = "ic") -> str:
    """select keys, n, ic with tie-averaged ranks; 0 where a side is constant."""
    k = f"{keys}, " if keys else ""
    pk = f"partition by {keys} " if keys else ""
    return f"""select {k}count(*) as n, coalesce(case when isfinite(corr(rx, ry)) then corr(rx, ry) end, 0.0) as {out} from (
      select {k}rank() over ({pk}order by {x}) + (count(*) over (partition by {k}{x}) - 1) / 2.0 as rx,
        rank() over ({pk}order by {y}) + (count(*) over (partition by {k}{y}) - 1) / 2.0 as ry
      from {source} where {x} is not null and {y} is not null) {'group by ' + keys if keys else ''}"""

BAD = """bad0 as (select *, 1 as arrival from bars union all
    select symbol, date, open, high, low, close + 1, volume, 2 from bars where day(date) % 7 = 0),
  bad as (select symbol, date, open, case when day(date) % 13 = 0 then low - 1 else high end as high, low,
    case when day(date) % 11 = 0 and arrival = 1 then -close else close end as close,
    case when day(date) % 5 = 0 then null else volume end as volume, arrival from bad0)"""

INSTRUMENTS = """instruments as (select p_partkey, ' ' || lpad(cast(p_partkey * 7919 % 700000 as varchar), 6, '0')
    || (['.sh', '.SZ', '.SHF', '.FXCM', '.XX', ''])[p_size % 6 + 1] as raw_symbol from part)"""

SNAP_B = """snap0 as (select *, row_number() over (partition by symbol order by date) as rn, count(*) over (partition by symbol) as n from bars),
  snapb as (select symbol, date, case when rn < n / 3.0 then open * 1.1 else open end as open, case when rn < n / 3.0 then high * 1.1 else high end as high,
    case when rn < n / 3.0 then low * 1.1 else low end as low, case when rn < n / 3.0 then close * 1.1 else close end as close, volume from snap0 where rn > 3)"""
