"""Overfitting probability, business days, resampled coverage and horizon blends against direct computations."""

import datetime as dt
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import calibration, cleaning, models, overfit
from panelspark.session import checkpoint_dir

DAY = dt.date(2021, 1, 4)


def pbo(x, blocks):
    """Every split of the blocks, the champion of one half judged among the others on the other half."""
    blocks = min(blocks, len(x) // 15) // 2 * 2
    part = np.arange(len(x)) // (len(x) // blocks)

    def ratio(which):
        r = x[np.isin(part, which)]
        sd = r.std(0)
        return np.where(sd > 1e-12, r.mean(0) / np.where(sd > 1e-12, sd, 1), 0)

    flags = []
    for ins in combinations(range(blocks), blocks // 2):
        a, o = ratio(ins), ratio([b for b in range(blocks) if b not in ins])
        champ = int(np.argmax(a))
        flags.append((o < o[champ]).sum() / (x.shape[1] - 1) < 0.5)
    return len(flags), float(np.mean(flags))


@pytest.mark.parametrize(("dates", "trials", "blocks"), [(130, 5, 8), (97, 4, 16), (61, 3, 16)])
def test_overfitting_probability(spark, dates, trials, blocks):
    x = np.random.default_rng(dates).normal(size=(dates, trials))
    x[:, 1] = 0.25  # a constant trial has ratio 0 and stays
    rows = [(f"t{j}", DAY + dt.timedelta(days=i), float(x[i, j])) for i in range(dates) for j in range(trials)]
    got = overfit.pbo_cscv(spark.createDataFrame(rows, "trial string, date date, ret double"), "trial", "date", n_blocks=blocks).collect()
    assert len(got) == 1 and (got[0]["splits"], round(got[0]["pbo"], 9)) == (pbo(x, blocks)[0], round(pbo(x, blocks)[1], 9))


def test_no_overfitting_probability_of_little(spark):
    few = spark.createDataFrame([(f"t{j}", DAY + dt.timedelta(days=i), float(i * j)) for i in range(29) for j in range(3)], "trial string, date date, ret double")
    assert overfit.pbo_cscv(few, "trial", "date").collect() == []
    assert overfit.pbo_cscv(few.limit(0), "trial", "date").collect() == []


def test_business_days_among_dense_holidays(spark):
    days = [DAY + dt.timedelta(days=i) for i in range(400)]
    off = {d for i, d in enumerate(days) if i < 200 and i % 13}
    hol = spark.createDataFrame([(d,) for d in off] * 2, "date date")
    got = [r["day"] for r in cleaning.business_days(spark.createDataFrame([("a", DAY)], "symbol string, d date"), "d", 12, hol).orderBy("step").collect()]
    assert got == [d for d in days[1:] if d.weekday() < 5 and d not in off][:12]
    assert cleaning.business_days(spark.createDataFrame([("a", DAY)], "symbol string, d date"), "d", 9).count() == 9


def test_coverage_interval_is_that_of_resamples(spark):
    rows = [("a", i % 10 != 0) for i in range(400)] + [("b", True)] * 50 + [("c", None)]
    got = {r["k"]: r for r in calibration.coverage_bootstrap(spark.createDataFrame(rows, "k string, covered boolean"), ["k"], draws=4000).collect()}
    rnd, flags = np.random.default_rng(0), np.array([v for k, v in rows if k == "a"])
    want = np.percentile(flags[rnd.integers(0, 400, (4000, 400))].mean(1), [2.5, 97.5])
    assert set(got) == {"a", "b"} and got["a"]["coverage"] == 0.9
    assert abs(got["a"]["ci_low"] - want[0]) < 0.004 and abs(got["a"]["ci_high"] - want[1]) < 0.004
    assert (got["b"]["ci_low"], got["b"]["ci_high"], got["b"]["n"]) == (1.0, 1.0, 50)


def test_blend_of_horizons(spark):
    rnd = np.random.default_rng(1)
    rows = [(f"s{i}", float(a), float(b), int(a + 0.3 * e > 0), int(b + 0.3 * e > 0)) for i, (a, b, e) in enumerate(rnd.normal(size=(300, 3)))]
    p = spark.createDataFrame(rows, "symbol string, x double, y double, t1 int, t5 int")
    panels = {1: p.withColumn("target", F.col("t1")), 5: p.withColumn("target", F.col("t5"))}
    m = models.train_horizons(panels, ["x", "y"], kind="logistic")
    new = spark.createDataFrame([("u", 2.0, -2.0), ("v", None, 1.0)], "symbol string, x double, y double")
    got = {r["symbol"]: r for r in models.score_horizons(m, new, {1: 3.0, 5: 1.0}).collect()}
    u, v = got["u"], got["v"]
    assert u["p_up_1"] > 0.9 and u["p_up_5"] < 0.1 and abs(u["p_up"] - (3 * u["p_up_1"] + u["p_up_5"]) / 4) < 1e-12
    assert u["direction"] == "up" and u["n_horizons"] == 2 and v["p_up"] is None and v["direction"] is None and v["n_horizons"] == 0


def test_checkpoint_folder_without_a_setting(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)
