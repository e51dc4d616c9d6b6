"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: warm median seconds, written to the noop sink, as one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelspark.plans import QUERIES  # noqa: E402
from panelspark.session import get_session  # noqa: E402

HEADLINE = ["bars_daily", "signal_ic_by_symbol", "base_features", "trailing_indicators", "exponential_averages", "price_factors", "rolling_factors",
            "macro_asof", "triple_barrier", "cross_section", "pooled_ic_by_horizon", "pooled_quantiles_bucketed", "horizon_gate", "conformal_coverage", "drift_report",
            "pbo_block_splits", "portfolio_metrics", "top_quantile", "period_returns", "hold_trades", "decision_feed", "tumbling_bars", "tick_asof_pooled"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    reps = int(os.environ.get("BENCH_REPS", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = get_session("bench", master=f"local[{cpus}]", shuffle=cpus)
    out = {}
    for n in names:
        times = []
        for i in range(reps + 1):
            t = time.perf_counter()
            QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - t)
        out[n] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
