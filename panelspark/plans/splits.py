"""Split queries (SP*, RM8, RM9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import splits as sp
from panelspark.operators.windows import rnd
from panelspark.plans import sqltext as q
from panelspark.plans.registry import query
from panelspark.sources import derive

POS = q.BARS + ", pos as (select symbol, date, row_number() over (order by date, symbol) - 1 as pos, count(*) over () as total from bars)"
WF = POS + """, wf0 as (select *, floor(total * 0.4) as f0, floor((total - floor(total * 0.4)) / 5) as step from pos), wf as (select symbol, date, pos, fold, case when pos >= f0 + fold * step and pos < case when fold = 4 then total else f0 + (fold + 1) * step end then 'test'
    when pos < f0 + fold * step then 'train' end as role from wf0, range(0, 5) t(fold))"""


def _b(spark, sf):
    return derive.bars(spark, sf).select("symbol", "date")


@query("walk_forward", "SP1 SO1", f"with {WF} select symbol, {q.D}, pos, fold, role from wf where role is not null")
def walk_forward(spark, sf):
    return rnd(sp.walk_forward(_b(spark, sf), 5).drop("total"))


@query("walk_forward_purged", "SP1", f"""with {WF}, dn as (select date, row_number() over (order by date) as k from (select distinct date from bars)), st as (select fold, min(k) as s from wf join dn using (date) where role = 'test' group by 1)
  select fold, role, count(*) as n, cast(min(date) as varchar) as first, cast(max(date) as varchar) as last from wf join dn using (date) join st using (fold) where role = 'test' or (role = 'train' and k < s - 5) group by 1, 2""")
def walk_forward_purged(spark, sf):
    w = sp.walk_forward(_b(spark, sf), 5, purge=5)
    return rnd(w.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last")))


@query("time_split", "SP2 SP4", f"with {POS} select symbol, {q.D}, case when pos < floor(total * 0.7) then 'train' when pos < floor(total * 0.85) then 'val' else 'test' end as segment from pos")
def time_split(spark, sf):
    return rnd(sp.time_split(_b(spark, sf), {"train": 0.7, "val": 0.15, "test": 0.15}).select("symbol", "date", "segment"))


@query("three_way_split", "SP4", f"with {POS} select segment, count(*) as n from (select case when pos < floor(total * 0.58) then 'proper' when pos < floor(total * 0.7) then 'calibration' else 'holdout' end as segment from pos) group by 1")
def three_way_split(spark, sf):
    return sp.time_split(_b(spark, sf), {"proper": 0.58, "calibration": 0.12, "holdout": 0.3}).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("rolling_periods", "SP3", f"with {POS} select symbol, {q.D}, cast(least(floor(pos / floor(total / 7)), 6) as int) as period from pos")
def rolling_periods(spark, sf):
    return rnd(sp.periods(_b(spark, sf), 7).select("symbol", "date", "period"))


@query("series_split", "RM9 SP2", f"with {q.BARS}, p as (select symbol, date, row_number() over ({q.W}) - 1 as pos, count(*) over (partition by symbol) as total from bars) select symbol, {q.D}, case when pos < floor(total * 0.8) then 'train' when pos < floor(total * 0.9) then 'val' else 'test' end as segment from p")
def series_split(spark, sf):
    return rnd(sp.time_split(_b(spark, sf), {"train": 0.8, "val": 0.1, "test": 0.1}, by_symbol=True).select("symbol", "date", "segment"))


@query("rebalance_grid", "SP7", f"with {q.BARS}, d as (select date, row_number() over (order by date) - 1 as k from (select distinct date from bars)) select {q.D} from d where k % 5 = 0")
def rebalance_grid(spark, sf):
    return rnd(sp.rebalance_dates(_b(spark, sf), 5))


CP = q.BARS + """, dd as (select date, row_number() over (order by date) - 1 as day_no, count(*) over () as nd from (select distinct date from bars)),
  cb as (select row_number() over (order by a, b) - 1 as path, a, b from range(0, 6) x(a), range(0, 6) y(b) where a < b), iv0 as (select path, unnest([a, b]) as block from cb),
  iv as (select path, block, block * (nd // 6) as lo, case when block = 5 then nd else (block + 1) * (nd // 6) end as hi from iv0, (select any_value(nd) as nd from dd)),
  roles as (select path, date, day_no, case when max((day_no >= lo and day_no < hi)::int) = 1 then 'test' when max((day_no >= lo - 4 and day_no < hi + 9)::int) = 0 then 'train' else 'purged' end as role from dd, iv group by 1, 2, 3)"""


def _roles(spark, sf):
    b = _b(spark, sf)
    iv = sp.cpcv_intervals(b, 6, 2, 5, 5)
    return sp.cpcv_roles(b, iv, 15), iv


@query("cpcv_roles", "SP5 UD4", f"with {CP} select path, {q.D}, day_no, role from roles")
def cpcv_roles(spark, sf):
    return rnd(_roles(spark, sf)[0])


@query("purge_audit", "SP6", f"with {CP} select path, block, sum((day_no + 4 >= lo and day_no < hi + 5)::int) as leaks, count(*) as train_dates from iv join roles using (path) where role = 'train' group by 1, 2")
def purge_audit(spark, sf):
    r, iv = _roles(spark, sf)
    return sp.purge_audit(r, iv, 5, 5)


@query("date_range_split", "RM8", f"""with {q.BARS}, dn as (select date, row_number() over (order by date) as d from (select distinct date from bars)), r(split, s, e) as (values ('train', date '1995-01-01', date '1998-12-31'), ('val', date '1999-01-01', date '1999-12-31'), ('test', date '2000-01-01', date '2001-12-31')),
  f as (select split, s, e, min(d) as f from r join dn on date >= s group by 1, 2, 3), j as (select symbol, date, split, count(*) over (partition by split, symbol) as n from bars join dn using (date) join f on d >= f - 30 and date <= e) select symbol, {q.D}, split from j where n >= 200""")
def date_range_split(spark, sf):
    r = {"train": ("1995-01-01", "1998-12-31"), "val": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2001-12-31")}
    return rnd(sp.date_range_split(_b(spark, sf), r, 30, 200).select("symbol", "date", "split"))
