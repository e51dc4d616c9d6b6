"""Calibration tables against direct fits."""

import numpy as np

from panelspark.operators import isotonic


def fitted(x, y):
    """max over a <= i of min over b >= i of the mean of a..b, over distinct x."""
    u = np.unique(x)
    s, n = np.array([y[x == v].sum() for v in u]), np.array([(x == v).sum() for v in u])
    cs, cn = np.concatenate(([0], s.cumsum())), np.concatenate(([0], n.cumsum()))
    m = np.array([[(cs[b + 1] - cs[a]) / (cn[b + 1] - cn[a]) if b >= a else np.inf for b in range(len(u))] for a in range(len(u))])
    return u, np.array([max(m[a, i:].min() for a in range(i + 1)) for i in range(len(u))])


def data(n=400, seed=2):
    rnd = np.random.default_rng(seed)
    x = np.round(rnd.random(n), 2)
    return x, (rnd.random(n) < 0.2 + 0.6 * x).astype(int)


def test_isotonic(spark):
    rows, want = [], {}
    for g in ("a", "b", None):
        x, y = data(seed=len(str(g)))
        rows += [(g, float(p), int(v)) for p, v in zip(x, y, strict=True)]
        want[g] = fitted(x, y)
    rows += [("a", None, 1), ("a", 0.5, None), ("a", float("nan"), 1)]
    df = spark.createDataFrame(rows, "g string, p_up double, y int")
    blocks = isotonic.fit_isotonic(df, ["g"])
    probe = spark.createDataFrame([(g, float(p)) for g in want for p in np.linspace(-0.1, 1.1, 61)] + [("a", None), ("new", 0.5)], "g string, p_up double")
    got = {(r["g"], r["p_up"]): r["calibrated"] for r in isotonic.apply_isotonic(probe, blocks, ["g"]).collect()}
    assert got["a", None] is None and got["new", 0.5] is None and len(got) == 3 * 61 + 2
    for g, (u, v) in want.items():
        for p in np.linspace(-0.1, 1.1, 61):
            assert abs(got[g, float(p)] - np.interp(p, u, v)) < 1e-9
    assert isotonic.fit_isotonic(df.limit(0), ["g"]).collect() == []


def test_pooling_block_by_block_is_one_pass(spark):
    x = np.arange(3000.0)
    y = (np.sin(x / 40) + x / 2000 + np.random.default_rng(0).normal(size=3000)).round(3)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "p_up double, y double")
    got = sorted((r["lo"], r["hi"], r["value"], r["n"]) for r in isotonic.fit_isotonic(df, []).collect())
    u, v = fitted(x, y)
    assert sum(r[3] for r in got) == 3000 and len(got) == len(np.unique(v.round(12)))
    for lo, hi, value, _ in got:
        assert np.allclose(v[(u >= lo) & (u <= hi)], value)


def test_platt(spark):
    x, y = data(900)
    x = np.clip(x, 0.02, 0.98)
    z = np.log(x / (1 - x))
    w = np.zeros(2)
    a = np.stack((z, np.ones_like(z)), 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-a @ w))
        w += np.linalg.solve(a.T @ (a * (q * (1 - q))[:, None]), a.T @ (y - q))
    df = spark.createDataFrame([("k", float(p), int(v)) for p, v in zip(x, y, strict=True)], "g string, p_up double, y int")
    r = isotonic.fit_platt(df, ["g"]).collect()
    assert len(r) == 1 and np.allclose([r[0]["slope"], r[0]["intercept"]], w, atol=1e-7)
    legs = {r["leg"]: r["brier"] for r in isotonic.calibrate_and_evaluate(df, df, ["g"]).collect()}
    assert set(legs) == {"base", "platt", "isotonic"} and legs["isotonic"] <= legs["platt"] + 1e-9
    assert abs(legs["base"] - float(((x - y) ** 2).mean())) < 1e-9
