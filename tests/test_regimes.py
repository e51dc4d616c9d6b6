"""Hidden Markov regimes against Baum-Welch and a forward filter written out row by row."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from panelspark.operators import regimes

DAY = dt.date(2020, 1, 1)


def series(n, seed):
    rnd = np.random.default_rng(seed)
    state = np.cumsum(rnd.random(n) < 0.06) % 3
    x = np.array([-0.03, 0.0, 0.03])[state] + rnd.normal(0, 0.012, n)
    return [(DAY + dt.timedelta(days=i), float(v), float(0.01 + 0.02 * (s == 0) + 0.002 * rnd.random())) for i, (v, s) in enumerate(zip(x, state, strict=True))]


def density(x, mu, var):
    return np.exp(-0.5 * ((x[:, None] - mu) ** 2 / var + np.log(2 * np.pi * var)).sum(-1))


def baum_welch(x, rounds, tol):
    """Scaled forward-backward over the whole series, three states."""
    n, s = len(x), 3
    mean, var = x.mean(0), np.maximum((x**2).mean(0) - x.mean(0) ** 2, 0)
    mu = np.tile(mean, (s, 1))
    mu[:, 0] += np.linspace(-1, 1, s) * np.sqrt(var[0])
    var, pi, a, old = np.tile(var + 1e-3, (s, 1)), np.full(s, 1 / 3), np.full((s, s), 0.1) + 0.7 * np.eye(s), -np.inf
    for _ in range(rounds):
        b = density(x, mu, var)
        al, be, z = np.zeros((n, s)), np.ones((n, s)), np.zeros(n)
        for t in range(n):
            al[t] = (pi if t == 0 else al[t - 1] @ a) * b[t]
            z[t] = al[t].sum()
            al[t] /= z[t]
        for t in range(n - 2, -1, -1):
            be[t] = a @ (b[t + 1] * be[t + 1]) / z[t + 1]
        like = np.log(z).sum()
        if like - old < tol:
            break
        old, g = like, al * be
        xi = sum(np.outer(al[t - 1], b[t] * be[t]) * a / z[t] for t in range(1, n))
        w, out = g.sum(0)[:, None], xi.sum(1, keepdims=True)
        pi, a = g[0] / g[0].sum(), np.where(out > 0, xi / np.maximum(out, 1e-300), a)
        mu = np.where(w > 1e-12, g.T @ x / np.maximum(w, 1e-300), mu)  # a state that no row is in stays where it is
        var = (1e-2 + g.T @ x**2 - 2 * mu * (g.T @ x) + mu**2 * w) / np.maximum(w, 1e-5)
    return pi, a, mu, var


def brute(x, start, every, rounds, tol):
    out = {}
    for cut in range(start, len(x) + 1, every):
        pi, a, mu, var = baum_welch(x[:cut], rounds, tol)
        order, v = mu[:, 0].argsort().argsort(), None
        for t, b in enumerate(density(x[: min(len(x), cut + every - 1)], mu, var)):
            v = (pi if v is None else v @ a) * b
            v = v / v.sum()
            if t >= cut - 1:
                out[t] = int(order[v.argmax()])
    return out


def test_labels_are_those_of_a_forward_filter(spark):
    sizes = {"a": 143, "b": 60, "c": 59, "d": 100}
    rows = [(p, *r) for k, (p, n) in enumerate(sizes.items()) for r in series(n, k)]
    rows += [("a", DAY - dt.timedelta(days=1), None, 0.01), ("a", DAY - dt.timedelta(days=2), float("nan"), 0.01)]
    obs = spark.createDataFrame(rows, "pool string, date date, log_ret double, vol double")
    got = {(r["pool"], r["date"]): r["state"] for r in regimes.labels(obs, max_rounds=20).collect()}
    want = {}
    for k, (p, n) in enumerate(sizes.items()):
        x = np.array([r[1:] for r in series(n, k)])
        want |= {(p, DAY + dt.timedelta(days=t)): s for t, s in brute(x, 60, 20, 20, 1e-4).items()}
    assert got == want and len(want) == 84 + 1 + 41
    assert len(set(got.values())) == 3


def test_later_rows_change_no_label(spark):
    obs = spark.createDataFrame([("a", *r) for r in series(120, 9)], "pool string, date date, log_ret double, vol double")
    kw = {"max_rounds": 10, "start": 40, "refit_every": 10}
    every = {r["date"]: r["regime"] for r in regimes.labels(obs, **kw).collect()}
    until = DAY + dt.timedelta(days=77)
    some = {r["date"]: r["regime"] for r in regimes.labels(obs.where(F.col("date") <= until), **kw).collect()}
    assert some == {d: x for d, x in every.items() if d <= until} and len(some) == 39
    assert regimes.labels(obs.limit(0), **kw).collect() == []


def test_fits_of_many_blocks_are_those_of_whole_series(spark):
    """Passes go block by block; a first chunk of its own length shifts all blocks, a refit may be longer than a block."""
    x = np.array([r[1:] for r in series(430, 5)])
    obs = spark.createDataFrame([("a", *r) for r in series(430, 5)], "pool string, date date, log_ret double, vol double")
    for start, every in ((130, 60), (210, 200)):
        got = {(r["date"] - DAY).days: r["state"] for r in regimes.labels(obs, start=start, refit_every=every, max_rounds=5).collect()}
        assert got == brute(x, start, every, 5, 1e-4) and len(got) == 430 - start + 1


def test_fits_are_dealt_by_work(spark, monkeypatch):
    """Rows of a pass are small for the work in them: the number of tasks must not follow their bytes."""
    parts, cut = [], regimes.cut_lineage

    def watched(df):
        out = cut(df)
        if out.columns == ["key", "fit", "p"]:
            parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(regimes, "cut_lineage", watched)
    obs = spark.createDataFrame([(k, *r) for k in "abcdefgh" for r in series(700, ord(k))], "pool string, date date, log_ret double, vol double")
    got = regimes.labels(obs, max_rounds=5)
    assert got.count() == 8 * 641
    assert len(parts) == 2 and parts[1] == 6  # 8 series of 33 fits, 5016 chunks, one task for 1000
