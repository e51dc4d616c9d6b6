"""Registered queries against their SQL on DuckDB at sf0.001.  All of them with PANELSPARK_FULL=1, otherwise a cross-section."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from panelspark.plans import IDS, ORACLES, QUERIES  # noqa: E402

SOME = ["signal_ic_by_symbol", "pooled_ic_bucketed", "base_features", "exponential_averages", "macro_asof", "tick_asof_pooled", "triple_barrier", "clean_bars_first",
        "asset_classes", "audit_report", "threshold_scan", "walk_forward", "cpcv_roles", "selection_turnover", "neutral_band", "conformal_quantiles", "drift_report",
        "pbo_paths", "portfolio_daily", "hold_trades", "order_rows", "decision_feed", "rolling_forecasts", "sliding_bars", "streamed_hour_bars"]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(ORACLES) if os.environ.get("PANELSPARK_FULL") else SOME)
def test_matches_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()) == "OK"


def test_entry(spark, sf):
    assert entry.entry(spark).columns == ["symbol", "n", "ic"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(IDS) == set(QUERIES) <= set(entry.queries())
