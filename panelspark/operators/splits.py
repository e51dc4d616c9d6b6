"""Fold assignment as data.

Row positions follow (date, symbol).  They come from running counts per date plus the rank inside the date, so no task
sorts the whole table; splits by date need only the per-date counts.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.order_stats import positions


def date_offsets(df: DataFrame) -> DataFrame:
    """(date, n, before, total): rows per date, rows before it, all rows.  One row per date."""
    g = df.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy(F.lit(1))
    return g.withColumns({"before": F.sum("n").over(one.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"), "total": F.sum("n").over(one)})


def global_positions(df: DataFrame) -> DataFrame:
    """Adds ``pos`` (0-based over date, symbol) and ``total``."""
    off = date_offsets(df).select("date", "before", "total")
    k = positions(df, ["date"], ["symbol"], "_k")
    return k.join(off, "date").withColumn("pos", F.col("before") + F.col("_k") - 1).drop("before", "_k")


def walk_forward(df: DataFrame, folds: int = 5, purge: int = 0) -> DataFrame:
    """(…, fold, role): the first 40 % trains, then equal test steps, the last takes the remainder; short inputs split
    70/30.  ``purge`` drops that many dates before each test block from training."""
    p = global_positions(df)
    first, tot = F.floor(F.col("total") * 0.4), F.col("total")
    single = (tot < 100) | F.lit(folds <= 1)
    step = F.floor((tot - first) / max(folds, 1))
    lo = F.when(single, F.floor(tot * 0.7)).otherwise(first + F.col("fold") * step)
    hi = F.when(single | (F.col("fold") == folds - 1), tot).otherwise(first + (F.col("fold") + 1) * step)
    x = p.withColumn("fold", F.explode(F.when(single, F.array(F.lit(0))).otherwise(F.array(*[F.lit(i) for i in range(max(folds, 1))]))))
    x = x.withColumns({"_lo": lo, "_hi": hi})
    role = F.when((F.col("pos") >= F.col("_lo")) & (F.col("pos") < F.col("_hi")), "test").when(F.col("pos") < F.col("_lo"), "train")
    x = x.withColumn("role", role).filter(F.col("role").isNotNull())
    if purge:
        days = df.select("date").distinct().withColumn("_day", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")))
        start = x.filter(F.col("role") == "test").groupBy("fold").agg(F.min("date").alias("date")).join(days, "date").select("fold", F.col("_day").alias("_start"))
        x = x.join(days, "date").join(F.broadcast(start), "fold")  # one row per fold
        x = x.filter((F.col("role") == "test") | (F.col("_day") < F.col("_start") - purge)).drop("_day", "_start")
    return x.drop("_lo", "_hi")


def time_split(df: DataFrame, fractions: dict[str, float], by_symbol: bool = False) -> DataFrame:
    """Named consecutive segments by cumulative fractions (train/val/test, proper-train/calibration/holdout, ...);
    the last takes the remainder."""
    if by_symbol:
        w = Window.partitionBy("symbol")
        p = df.withColumns({"pos": F.row_number().over(w.orderBy("date")) - 1, "total": F.count(F.lit(1)).over(w)})
    else:
        p = global_positions(df)
    names, acc, e = list(fractions), 0.0, None
    for n in names[:-1]:
        acc = round(acc + fractions[n], 12)
        cond = F.col("pos") < F.floor(F.col("total") * acc)
        e = F.when(cond, n) if e is None else e.when(cond, n)
    return p.withColumn("segment", e.otherwise(names[-1]) if e is not None else F.lit(names[0]))


def periods(df: DataFrame, k: int) -> DataFrame:
    """``k`` equal consecutive periods by position; the remainder goes to the last."""
    p = global_positions(df)
    return p.withColumn("period", F.least(F.floor(F.col("pos") / F.greatest(F.floor(F.col("total") / k), F.lit(1))), F.lit(k - 1)).cast("int"))


def rebalance_dates(df: DataFrame, h: int, column: str = "date") -> DataFrame:
    """Every ``h``-th distinct date, so holding periods do not overlap."""
    d = df.select(column).distinct().withColumn("_k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(column)) - 1)
    return d.filter(F.col("_k") % h == 0).drop("_k")


def cpcv_intervals(df: DataFrame, n_blocks: int = 6, k: int = 2, h: int = 5, embargo: int = 5) -> DataFrame:
    """Combinatorial purged paths as date-number intervals: (path, block, lo, hi, purge_lo, purge_hi).

    C(n_blocks, k) * k rows, generated from the block count; only the number of dates comes from the data.
    """
    n = df.agg(F.count_distinct("date").alias("n_dates"))
    combos = list(combinations(range(n_blocks), k))
    rows = F.array(*[F.struct(F.lit(i).alias("path"), F.lit(b).alias("block")) for i, c in enumerate(combos) for b in c])
    x = n.withColumn("_x", F.explode(rows)).select("n_dates", "_x.*")
    size = F.floor(F.col("n_dates") / n_blocks)
    x = x.withColumns({"lo": F.col("block") * size, "hi": F.when(F.col("block") == n_blocks - 1, F.col("n_dates")).otherwise((F.col("block") + 1) * size)})
    return x.withColumns({"purge_lo": F.col("lo") - (h - 1), "purge_hi": F.col("hi") + (h - 1) + embargo}).drop("n_dates")


def cpcv_roles(df: DataFrame, intervals: DataFrame, paths: int) -> DataFrame:
    """(path, date, role): test inside an interval, train outside every purged interval, dropped in between.

    Runs on the date axis (one row per date), to be joined to rows by date.
    """
    days = df.select("date").distinct().withColumn("day_no", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")) - 1)
    grid = days.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))))
    j = grid.join(F.broadcast(intervals), "path")  # C(n_blocks, k) * k rows
    inside = (F.col("day_no") >= F.col("lo")) & (F.col("day_no") < F.col("hi"))
    near = (F.col("day_no") >= F.col("purge_lo")) & (F.col("day_no") < F.col("purge_hi"))
    g = j.groupBy("path", "date", "day_no").agg(F.max(inside.cast("int")).alias("_t"), F.max(near.cast("int")).alias("_n"))
    return g.withColumn("role", F.when(F.col("_t") == 1, "test").when(F.col("_n") == 0, "train").otherwise("purged")).drop("_t", "_n")


def purge_audit(roles: DataFrame, intervals: DataFrame, h: int, embargo: int) -> DataFrame:
    """Training dates per interval whose label reaches into the test block or that fall into its embargo (must be 0)."""
    train = roles.filter(F.col("role") == "train").select("path", "day_no")
    j = F.broadcast(intervals).join(train, "path")
    leak = (F.col("day_no") + (h - 1) >= F.col("lo")) & (F.col("day_no") < F.col("hi") + embargo)
    return j.groupBy("path", "block").agg(F.sum(leak.cast("int")).alias("leaks"), F.count(F.lit(1)).alias("train_dates"))


def date_range_split(bars: DataFrame, ranges: dict[str, tuple[str, str]], lookback: int, min_length: int) -> DataFrame:
    """Named date ranges, each extended backwards by ``lookback`` calendar positions, for symbols long enough in it."""
    days = bars.select("date").distinct().withColumn("_d", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")))
    x = bars.join(days, "date")
    arr = F.array(*[F.struct(F.lit(n).alias("split"), F.lit(a).cast("date").alias("start"), F.lit(b).cast("date").alias("end")) for n, (a, b) in ranges.items()])
    first = days.withColumn("_x", F.explode(arr)).select("_d", "date", "_x.*").filter(F.col("date") >= F.col("start")).groupBy("split", "end").agg(F.min("_d").alias("_from"))
    j = x.join(F.broadcast(first), (F.col("_d") >= F.col("_from") - lookback) & (F.col("date") <= F.col("end")))  # one row per split
    n = F.count(F.lit(1)).over(Window.partitionBy("split", "symbol"))
    return j.withColumn("_n", n).filter(F.col("_n") >= min_length).drop("_d", "_from", "_n", "end")
