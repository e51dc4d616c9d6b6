"""Guarded row windows over one ordered series per key.

A key's rows are bounded by its calendar once ``(symbol, date)`` is unique (see cleaning.dedupe), so daily and
hourly bars use plain ``partitionBy(symbol)`` windows.  Series without such a bound (ticks) go through
``panelspark.operators.blocks`` which cuts a key into row blocks with an overlap.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


class Series:
    """Expression builder bound to a partition key and an order."""

    def __init__(self, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("date",)):
        self.keys, self.order = tuple(keys), tuple(order)

    @property
    def w(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def frame(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def guarded(self, agg: Callable[[Column], Column], c: str | Column, n: int, min_periods: int | None = None) -> Column:
        c, fr = col(c), self.frame(n)
        return F.when(F.count(c).over(fr) >= (n if min_periods is None else min_periods), agg(c).over(fr))

    def mean(self, c, n, min_periods=None) -> Column:
        return self.guarded(F.avg, c, n, min_periods)

    def std(self, c, n, min_periods=None) -> Column:
        return self.guarded(F.stddev_samp, c, n, min_periods)

    def std_pop(self, c, n, min_periods=None) -> Column:
        return self.guarded(F.stddev_pop, c, n, min_periods)

    def sum(self, c, n, min_periods=None) -> Column:
        return self.guarded(F.sum, c, n, min_periods)

    def max(self, c, n, min_periods=None) -> Column:
        return self.guarded(F.max, c, n, min_periods)

    def min(self, c, n, min_periods=None) -> Column:
        return self.guarded(F.min, c, n, min_periods)

    def lag(self, c, n: int = 1) -> Column:
        return F.lag(col(c), n).over(self.w)

    def lead(self, c, n: int = 1) -> Column:
        return F.lead(col(c), n).over(self.w)

    def diff(self, c, n: int = 1) -> Column:
        return col(c) - self.lag(c, n)

    def pct(self, c, n: int = 1) -> Column:
        return col(c) / self.lag(c, n) - 1

    def cumsum(self, c) -> Column:
        return F.sum(col(c)).over(self.w.rowsBetween(Window.unboundedPreceding, 0))

    def row(self) -> Column:
        return F.row_number().over(self.w)

    def with_zscore(self, df: DataFrame, columns: Sequence[str], n: int, min_periods: int, suffix: str = "_z") -> DataFrame:
        """Adds trailing z-scores: every number comes from the ``n`` rows up to the row itself.

        A window with too few values, or whose values are all equal, scores 0, and so does a null value.
        """
        fr, z = self.frame(n), {}
        for c in columns:
            ok = (F.count(c).over(fr) >= min_periods) & (F.max(c).over(fr) > F.min(c).over(fr))
            z[c + suffix] = F.coalesce(F.when(ok, (F.col(c) - F.avg(c).over(fr)) / F.stddev_samp(c).over(fr)), F.lit(0.0))
        return df.select("*", *[v.alias(k) for k, v in z.items()])


def by_series(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Hash-partitions by the series key with the full partition count.

    Trailing windows are CPU-bound: without the explicit count the adaptive planner merges the small partitions of a
    compact bar table into one task.  The windows above reuse this partitioning, so it replaces their shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def pearson(x, y, over=None) -> Column:
    """Correlation as covariance over deviations: null for a constant side (``corr`` raises there in ANSI mode)."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    parts = [F.covar_pop(x, y), F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))]
    c, a, b = [p.over(over) if over is not None else p for p in parts]
    return F.try_divide(c, a * b)


def nonzero(c: str | Column, eps: float = 1e-10) -> Column:
    c = col(c)
    return F.when(c == 0, F.lit(eps)).otherwise(c)


def finite(c: str | Column) -> Column:
    """NaN and infinities become null."""
    c = col(c)
    return F.when(F.abs(c) < float("inf"), c)  # NaN sorts above infinity


def clip(c: str | Column, lo: float, hi: float) -> Column:
    """Bounds a value; null stays null (greatest/least alone would skip nulls)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def rnd(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    """Comparable output: floats on a decimal grid whose cell borders avoid short decimals, dates as text."""
    out = []
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        if dtype in ("double", "float"):
            scale = float(10 ** per_column.get(name, digits))
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.floor(c * scale + 0.70710678) / scale)
        elif dtype in ("date", "timestamp"):
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)
