"""Recursive series columns (exponential averages, adaptive averages) in one grouped Arrow pass per key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ewm(s: pd.Series, *, span: float | None = None, alpha: float | None = None) -> pd.Series:
    """y0 = x0, y = a x + (1 - a) y; leading nulls are skipped."""
    a = alpha if alpha is not None else 2.0 / (span + 1.0)
    return s.ewm(alpha=a, adjust=False).mean()


def with_recursive(df: DataFrame, fn: Callable[[pd.DataFrame], dict[str, pd.Series]], names: Sequence[str],
                   keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("date",),
                   warm: str | None = None) -> DataFrame:
    """Runs ``fn`` on each ordered series and appends its columns.

    ``keys`` must name groups bounded by their calendar, or blocks made by ``blocks.blocked`` (then pass
    ``warm='_warm'`` so the warm-up rows are dropped after the recursion).
    """
    schema = T.StructType([f for f in df.schema.fields] + [T.StructField(n, T.DoubleType()) for n in names])
    order, names = list(order), list(names)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="mergesort").reset_index(drop=True)
        new = fn(pdf)
        pdf = pd.concat([pdf, pd.DataFrame({n: new[n] for n in names})], axis=1)
        return pdf[~pdf[warm]] if warm else pdf

    return df.groupBy(*keys).applyInPandas(run, schema)
