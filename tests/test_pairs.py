"""Strong pairs and the eigen spectrum against numpy."""

import datetime as dt

import numpy as np

from panelspark.operators import pairs

DAY = dt.date(2020, 1, 1)


def panel(spark, x):
    rows = [(f"s{i:03d}", DAY + dt.timedelta(days=t), float(v)) for i, r in enumerate(x) for t, v in enumerate(r) if np.isfinite(v)]
    return spark.createDataFrame([*rows, ("s000", DAY + dt.timedelta(days=999), None)], "symbol string, date date, ret double")


def data(n=90, t=150, gaps=True, seed=4):
    rnd = np.random.default_rng(seed)
    f = rnd.normal(size=(6, t))
    x = f[np.arange(n) % 6] * np.where(np.arange(n) % 5 == 0, -1, 1)[:, None] + rnd.normal(size=(n, t)) * rnd.uniform(0.2, 0.9, (n, 1))
    if gaps:
        for i in range(0, n, 4):
            x[i, rnd.random(t) < 0.3] = np.nan
        x[3, 40:] = np.nan
        x[7] = 1.0
    return x


def brute(x, bound, least):
    out = {}
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            m = np.isfinite(x[i]) & np.isfinite(x[j])
            if m.sum() >= least and x[i][m].std() > 0 and x[j][m].std() > 0:
                r = np.corrcoef(x[i][m], x[j][m])[0, 1]
                if abs(r) >= bound:
                    out[f"s{i:03d}", f"s{j:03d}"] = (int(m.sum()), round(r, 9))
    return out


def test_strong_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 16)
    for gaps in (True, False):
        x = data(gaps=gaps)
        got = {(r["a"], r["b"]): (r["n"], round(r["rho"], 9)) for r in pairs.strong_pairs(panel(spark, x)).collect()}
        want = brute(x, 0.8, 60)
        assert got == want and len(want) > 50
    assert pairs.strong_pairs(panel(spark, data()).limit(0)).collect() == []


def test_spectrum(spark):
    x = data(n=40, t=120, gaps=False)
    c = np.corrcoef(x)
    want = np.sort(np.linalg.eigvalsh(c))[::-1][:3]
    got = [(r["component"], r["eigenvalue"], r["share"]) for r in pairs.eigen_spectrum(panel(spark, x)).collect()]
    assert [g[0] for g in got] == [1, 2, 3]
    assert np.allclose([g[1] for g in got], want, rtol=1e-6) and np.allclose([g[2] for g in got], want / 40, rtol=1e-6)
    mean = x.mean(0)
    res = np.stack([r - np.polyval(np.polyfit(mean, r, 1), mean) for r in x])
    want = np.sort(np.linalg.eigvalsh(np.corrcoef(res)))[::-1][:3]
    got = [r["eigenvalue"] for r in pairs.eigen_spectrum(panel(spark, x), residual=True).collect()]
    assert np.allclose(got, want, rtol=1e-6)


def test_spectrum_of_few_and_of_none(spark):
    x = data(n=2, t=80, gaps=False)
    got = [r["eigenvalue"] for r in pairs.eigen_spectrum(panel(spark, x)).collect()]
    assert np.allclose(got, np.sort(np.linalg.eigvalsh(np.corrcoef(x)))[::-1], rtol=1e-6)
    assert pairs.eigen_spectrum(panel(spark, x).limit(0)).collect() == []
