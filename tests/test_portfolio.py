"""Portfolio accounting and statistics on hand-computed fixtures."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import scalar as fx
from panelspark.operators import aggregates as ag, calibration as ca, overfit as of, portfolio as pf, splits as sp, statistics as st


def series(spark, sym, close, weight=None):
    d = pd.DataFrame({"symbol": sym, "date": pd.date_range("2026-01-01", periods=len(close)).date, "close": [float(c) for c in close]})
    if weight is not None:
        d["target_weight"] = [float(w) for w in weight]
    return spark.createDataFrame(d)


def test_yesterdays_weight_earns_todays_return(spark):
    p = series(spark, "A", [100, 110, 110, 121], [0, 1, 1, 1])
    d = pf.account(p.drop("close"), p.drop("target_weight"), cost=0.001).orderBy("date").toPandas()
    assert np.allclose(d["gross"], [0, 0, 0, 0.10])  # the jump on the entry day earns nothing
    assert np.allclose(d["turnover"], [0, 1, 0, 0]) and np.allclose(d["cost"], [0, 0.001, 0, 0])
    assert abs(d["equity"].iloc[-1] - (1 - 0.001) * 1.10) < 1e-12


def test_first_day_turnover_and_problem_report(spark):
    p = series(spark, "A", [100, 100, 100], [1, 1, 1])
    d = pf.account(p.drop("close"), p.drop("target_weight")).orderBy("date").toPandas()
    assert d["turnover"].tolist() == [1, 0, 0]
    bad = {r["reason"]: r["n"] for r in pf.plan_problems(series(spark, "B", [1, 1], [2, 0.5]).drop("close"), p).collect()}
    assert bad["unknown_symbol"] == 1 and bad["weight_out_of_range"] == 1 and bad["too_few_dates"] == 1


def test_compound_handles_total_loss(spark):
    df = spark.createDataFrame([(1, 0.1), (2, -0.5), (3, -2.0)], "i int, r double")
    assert abs(df.agg(pf.compound(F.col("r")).alias("v")).first()["v"] - (1.1 * 0.5 * -1.0)) < 1e-12
    assert spark.createDataFrame([(-1.0,), (0.5,)], "r double").agg(pf.compound(F.col("r")).alias("v")).first()["v"] == 0.0


def test_hold_trades_do_not_overlap(spark):
    p = series(spark, "A", [100, 101, 102, 103, 104, 105, 106]).withColumn("action", F.lit("BUY"))
    t = pf.hold_trades(p, 2, fee=0.0).orderBy("entry_date").toPandas()
    assert len(t) == 2 and (t["entry_date"].iloc[1] > t["exit_date"].iloc[0])
    assert np.allclose(t["ret"], [102 / 100 - 1, 105 / 103 - 1])


def test_normal_functions_and_p_values(spark):
    z = [-6.0, -2.0, -0.3, 0.0, 0.7, 3.9, 4.1, 8.0]
    df = spark.createDataFrame([(v,) for v in z], "z double")
    got = [r[0] for r in df.select(fx.normal_cdf("z")).collect()]
    assert np.allclose(got, [0.5 * math.erfc(-v / math.sqrt(2)) for v in z], rtol=1e-9, atol=1e-15)
    p = spark.createDataFrame([(0.001,), (0.3,), (0.975,)], "p double").select(fx.normal_ppf("p")).collect()
    assert np.allclose([r[0] for r in p], [-3.090232306, -0.524400513, 1.959963985], atol=1e-6)


def test_fingerprint_ignores_key_order(spark):
    df = spark.sql("select map('b', '1', 'a', '2') as x, map('a', '2', 'b', '1') as y")
    r = df.select(fx.fingerprint("x").alias("x"), fx.fingerprint("y").alias("y")).first()
    assert r["x"] == r["y"] and len(r["x"]) == 16


def test_drift_and_insufficient_samples(spark):
    r = np.random.default_rng(7)
    ref = pd.DataFrame({"feature": "same", "side": "ref", "value": r.normal(size=300)})
    rows = [ref, ref.assign(side="cur", value=r.normal(size=300)), ref.assign(feature="moved"), ref.assign(feature="moved", side="cur", value=r.normal(2, 1, 300)),
            ref.head(10).assign(feature="short"), ref.head(10).assign(feature="short", side="cur")]
    out = {x["feature"]: x for x in of.drift_report(spark.createDataFrame(pd.concat(rows)), ["feature"]).collect()}
    assert out["same"]["psi"] < 0.1 and out["moved"]["verdict"] == "significant_drift" and out["short"]["verdict"] == "unavailable"


def test_overfit_probability_direction(spark):
    r = np.random.default_rng(2)
    t, n = 240, 6
    good = r.normal(0, 0.01, (t, n))
    good[:, 0] += 0.01
    flip = r.normal(0, 0.001, (t, n)) + np.where(np.arange(t)[:, None] < t // 2, 0.01, -0.01) * np.linspace(-1, 1, n)

    def run(m):
        p = pd.DataFrame([(str(j), i, float(m[i, j])) for i in range(t) for j in range(n)], columns=["trial", "day", "ret"])
        return of.pbo_cscv(spark.createDataFrame(p), "trial", "day", n_blocks=6).first()["pbo"]

    assert run(good) < 0.1 < run(flip)


def test_conformal_unreachable_level_is_null(spark):
    d = spark.createDataFrame([("g", float(i)) for i in range(9)], "g string, resid double")
    out = {round(x["alpha"], 2): x["q"] for x in ca.conformal_quantiles(d, ["g"], [0.05, 0.5]).collect()}
    assert out[0.05] is None and out[0.5] == pytest.approx(float(np.quantile(range(9), 5 / 9)))


def test_walk_forward_and_cpcv_have_no_leak(spark):
    days = pd.date_range("2025-01-01", periods=60).date
    p = spark.createDataFrame(pd.DataFrame([(s, d) for d in days for s in ("A", "B", "C")], columns=["symbol", "date"]))
    w = sp.walk_forward(p, 4, purge=3).toPandas()
    for _, g in w.groupby("fold"):
        a, b = g[g.role == "train"]["date"].max(), g[g.role == "test"]["date"].min()
        assert (pd.Timestamp(b) - pd.Timestamp(a)).days > 3
    assert w[w.role == "test"].groupby("fold").size().sum() == 180 - 72
    iv = sp.cpcv_intervals(p, 6, 2, h=5, embargo=2)
    roles = sp.cpcv_roles(p, iv, 15)
    assert sp.purge_audit(roles, iv, 5, 2).agg(F.max("leaks")).first()[0] == 0


def test_holm_and_bins(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "test string, p double")
    h = {r["test"]: r["p_holm"] for r in st.multiple_testing(t).collect()}
    assert h == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})
    s = spark.createDataFrame([(0.05, True, 0.1)] * 6 + [(1.0, False, -0.1)] * 6, "confidence double, hit boolean, actual_return double")
    rows = {r["bin"]: r for r in ag.confidence_bins(s, [0.0, 0.5, 0.9, 1.0]).collect()}
    assert rows[1]["samples"] == 0 and not rows[1]["available"] and rows[2]["samples"] == 6


def test_partial_correlation_matches_residual_form(spark):
    r = np.random.default_rng(4)
    z = r.normal(size=400)
    pdf = pd.DataFrame({"k": "a", "x": z + r.normal(size=400), "y": z + r.normal(size=400), "z": z})
    got = st.partial_spearman(spark.createDataFrame(pdf), ["k"], "x", "y", "z").first()["partial_ic"]
    q = pdf[["x", "y", "z"]].rank()
    res = [q[c] - np.polyval(np.polyfit(q["z"], q[c], 1), q["z"]) for c in ("x", "y")]
    assert abs(got - np.corrcoef(*res)[0, 1]) < 1e-9


def test_topk_dropout_and_all_in(spark):
    days = pd.date_range("2026-01-01", periods=3).date
    p = [[0.9, 0.8, 0.1, 0.2], [0.1, 0.8, 0.9, 0.2], [0.1, 0.2, 0.9, 0.8]]
    rows = [("x", d, s, p[i][j]) for i, d in enumerate(days) for j, s in enumerate("ABCD")]
    h = pf.topk_dropout(spark.createDataFrame(rows, "plan string, date date, symbol string, p_up double"), 2, 1, 1).toPandas()
    held = h.groupby("date")["symbol"].apply(lambda s: "".join(sorted(s))).tolist()
    assert held == ["AB", "BC", "CD"]  # at most one name is replaced per date
    path = spark.createDataFrame([("A", d, px, pos) for d, px, pos in zip(days, (100.0, 110.0, 110.0), (1, 1, 0), strict=True)], "symbol string, date date, price double, position int")
    r = pf.all_in_simulator(path, capital=1000.0, fee=0.0).first()
    assert r["final_equity"] == pytest.approx(1100.0) and r["trades"] == 2  # idle cash is kept when closing


def test_trading_metrics_follow_their_definition(spark):
    from panelspark.operators import statistics as st

    def one(rets, horizon=1, fee=0.0):
        df = spark.createDataFrame([("a", i, 0.9, int(r > 0), r) for i, r in enumerate(rets)], "k string, date int, p_up double, y int, fwd_ret double")
        return st.trading_metrics(df, ["k"], ["date"], horizon=horizon, fee=fee).first()

    m = one([-0.05, 0.02, 0.04], 5, 0.001)
    net = np.array([-0.05, 0.02, 0.04]) - 0.002
    assert abs(m["sharpe"] - net.mean() / net.std() * np.sqrt(252 / 5)) < 1e-12 and m["max_drawdown"] == 0 and abs(m["total_return"] - net.sum()) < 1e-15
    m = one([5.0, -0.001])
    assert abs(m["profit_factor"] - 5000) < 1e-9 and not m["profit_factor_is_capped"]
    m = one([5.0, 1.0])
    assert m["profit_factor"] == 999 and m["profit_factor_is_capped"]


def hour_events(tmp_path, spark, rows):
    """rows: (event_type, hours since the start, value)."""
    spark.createDataFrame(rows, "event_type string, h int, value double").select(
        F.monotonically_increasing_id().alias("event_id"), (F.timestamp_seconds(F.lit(1704067200) + F.col("h") * 3600)).alias("ts"), F.lit(1).cast("long").alias("user_id"), "event_type", "value", F.lit("{}").alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_buy_and_hold_growth_beyond_the_range_of_doubles(spark, tmp_path):
    from panelspark.plans import QUERIES

    sf = hour_events(tmp_path, spark, [("a", h, 1.0 if h % 2 else 1e-200) for h in range(5)] + [("a", 5, 1.0), ("b", 0, 1.0)] + [("b", h, 1.0) for h in range(1, 6)])
    got = QUERIES["buy_hold_plan"](spark, sf).first()
    assert abs(got["log_return"] - (3 * math.log(0.5e200) + 2 * math.log(0.5) - 0.00075)) < 1e-3


def test_daily_portfolio_is_undefined_after_a_loss_of_more_than_everything(spark, tmp_path):
    from panelspark.plans import ORACLES, QUERIES

    sf = hour_events(tmp_path, spark, [("a", h, v) for h, v in enumerate([1.0, 1.0, 1.0, 2.0, 1e-5, 1.0, 1.0, 3.0, 3.0])] + [("b", h, 5.0) for h in range(9)])
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet/*.parquet'")
    columns = ["tier", "date", "n_active", "gross", "turnover", "cost", "net", "drawdown", "log_equity"]
    got = QUERIES["portfolio_daily"](spark, sf).select(*columns).toPandas().sort_values(["tier", "date"])
    want = con.execute(ORACLES["portfolio_daily"]).df()[columns].sort_values(["tier", "date"])
    assert got["drawdown"].isna().any() and got["drawdown"].notna().any()
    for c in columns[2:]:
        assert np.allclose(got[c].astype(float), want[c].astype(float), atol=1e-9, equal_nan=True), c
