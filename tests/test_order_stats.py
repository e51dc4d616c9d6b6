"""The bucketed path must equal the plain one, with ties, several groups and one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import blocks, joins, order_stats as os_
from panelspark.operators.recursion import ewm, with_recursive
from panelspark.operators.windows import Series


@pytest.fixture(scope="module")
def skewed(spark):
    r = np.random.default_rng(3)
    n = 3000
    g = np.where(r.random(n) < 0.7, "hot", r.choice(["a", "b"], n))
    x = np.where(r.random(n) < 0.3, 0.5, np.round(r.normal(size=n), 2))
    y = np.round(x * 0.5 + r.normal(size=n), 2)
    return pd.DataFrame({"id": np.arange(n), "g": g, "x": x, "y": y})


def test_ranks_and_spearman(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = os_.with_average_rank(df, ["g"], "x", "r").toPandas().set_index("id")["r"].sort_index()
    want = skewed.groupby("g")["x"].rank(method="average")
    assert np.allclose(got.to_numpy(), want.to_numpy())
    a = os_.spearman(df, ["g"], "x", "y").toPandas().set_index("g")
    b = os_.spearman(df, ["g"], "x", "y", bounded=True).toPandas().set_index("g")
    for k, p in skewed.groupby("g"):
        w = p["x"].rank().corr(p["y"].rank())
        assert abs(a.loc[k, "ic"] - w) < 1e-12 and abs(b.loc[k, "ic"] - w) < 1e-12


def test_spearman_constant_side_is_zero(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [1.0] * 5, "y": range(5)}))
    for bounded in (True, False):
        assert os_.spearman(df, [], "x", "y", bounded=bounded).first()["ic"] == 0.0


def test_positions_and_running(spark, skewed):
    df = spark.createDataFrame(skewed)
    p = os_.positions(df, ["g"], ["x", "id"]).toPandas().sort_values("id")
    want = skewed.sort_values(["x", "id"]).groupby("g").cumcount().add(1).sort_index()
    assert (p["pos"].to_numpy() == want.to_numpy()).all()
    m = os_.running(df, ["g"], ["id"], {"s": "y"}, {"m": "y"}).toPandas().sort_values("id")
    assert np.allclose(m["s"], skewed.groupby("g")["y"].cumsum()) and np.allclose(m["m"], skewed.groupby("g")["y"].cummax())


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_any_number_of_levels_gives_the_same(spark, skewed, depth, monkeypatch):
    """Null keys, null values, one value alone in its group, equal order keys; few edges a level, so every level cuts."""
    rows = [(i, None if i % 5 == 0 else "g" if i % 2 else "h", None if i % 7 == 0 else float(i % 13)) for i in range(400)] + [(900, "one", 4.0), (901, "empty", None)]
    df = spark.createDataFrame(rows, "id int, g string, x double")
    if depth:
        real = os_.bucketed
        monkeypatch.setattr(os_, "bucketed", lambda d, keys, order, classes=8, depth_=depth: real(d, keys, order, 8, depth_))
    small = depth == 0
    pos = {r["id"]: r["pos"] for r in os_.positions(df, ["g"], ["x", "id"], small=small).collect()}
    rank = {r["id"]: r["r"] for r in os_.with_average_rank(df, ["g"], "x", "r", small=small).collect()}
    p = pd.DataFrame(rows, columns=["id", "g", "x"])
    p["g"] = p["g"].fillna("null")
    order = p.assign(k=p["x"].fillna(-1)).sort_values(["k", "id"])
    want = dict(zip(order["id"], order.groupby("g").cumcount() + 1, strict=True))
    assert pos == want
    wr = p.groupby("g")["x"].rank(method="average")
    assert all((rank[i] is None and np.isnan(w)) or rank[i] == w for i, w in zip(p["id"], wr, strict=True))
    q = {(r["g"], r["prob"]): r["q"] for r in os_.quantiles(df, ["g"], "x", [0.0, 0.3, 1.0], small=small).collect()}
    for k, d in p.dropna(subset="x").groupby("g"):
        for f in (0.0, 0.3, 1.0):
            assert abs(q[(None if k == "null" else k, f)] - np.quantile(d["x"], f)) < 1e-12
    assert len(q) == 12


def test_levels_grow_with_the_input(spark, monkeypatch):
    df = spark.range(10)
    assert os_.levels(df) == 1
    monkeypatch.setattr(os_, "BUCKET_BYTES", 1e-4)
    assert os_.levels(df) == 3


def test_asof_join_matches_null_keys(spark):
    left, right = spark.createDataFrame([(None, 5, 1), ("a", 5, 2)], "k string, t int, id int"), spark.createDataFrame([(None, 3, 7.0), ("a", 9, 8.0)], "k string, t int, v double")
    for small in (True, False):
        got = {r["id"]: r["asof_v"] for r in joins.asof_join(left, right, ["k"], "t", ["v"], small=small).collect()}
        assert got == {1: 7.0, 2: None}


@pytest.mark.parametrize("small", [True, False])
def test_quantiles(spark, skewed, small):
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    q = os_.quantiles(spark.createDataFrame(skewed), ["g"], "y", probs, small=small).toPandas()
    for k, p in skewed.groupby("g"):
        got = q[q.g == k].sort_values("prob")["q"].to_numpy()
        assert np.allclose(got, np.quantile(p["y"], probs))


@pytest.mark.parametrize("small", [True, False])
def test_asof_join(spark, small):
    r = np.random.default_rng(5)
    left = pd.DataFrame({"k": r.choice(["a", "b"], 800, p=[0.8, 0.2]), "t": np.sort(r.integers(0, 5000, 800)), "id": range(800)})
    right = pd.DataFrame({"k": r.choice(["a", "b"], 120), "t": np.sort(r.choice(5000, 120, replace=False)), "v": r.normal(size=120)})
    got = joins.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", ["v"], small=small).toPandas().sort_values("id")
    want = pd.merge_asof(left, right, on="t", by="k").sort_values("id")
    assert np.allclose(got["asof_v"].fillna(-9), want["v"].fillna(-9))


def test_blocks_equal_whole_series(spark):
    r = np.random.default_rng(9)
    pdf = pd.DataFrame({"symbol": ["hot"] * 900 + ["s"] * 50, "t": [*range(900), *range(50)], "price": r.normal(size=950).cumsum()})
    a = 0.5
    b = blocks.blocked(spark.createDataFrame(pdf), ["symbol"], ["t"], halo=blocks.halo_for(a), block=100)
    b = b.withColumn("ma", Series(keys=("symbol", "_blk"), order=("pos",)).mean("price", 30))
    out = with_recursive(b, lambda p: {"e": ewm(p["price"], alpha=a)}, ["e"], keys=("symbol", "_blk"), order=("pos",), warm="_warm").toPandas().sort_values(["symbol", "t"])
    assert len(out) == len(pdf) and out.groupby(["symbol", "_blk"]).size().max() <= 100
    g = pdf.groupby("symbol")["price"]
    assert np.allclose(out["ma"].fillna(-1), g.transform(lambda s: s.rolling(30).mean()).fillna(-1))
    assert np.allclose(out["e"], g.transform(lambda s: s.ewm(alpha=a, adjust=False).mean()), rtol=0, atol=1e-12)


def test_rolling_zscore_by_running_sums(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([[np.nan] * 3, r.normal(size=300), [2.0] * 40])
    pdf = pd.DataFrame({"symbol": "a", "date": pd.date_range("2020-01-01", periods=len(x)).date, "x": x})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = Series().with_zscore(df, ["x"], 30, 5).toPandas().sort_values("date")["x_z"].to_numpy()
    s = pd.Series(x)
    want = ((s - s.rolling(30, min_periods=5).mean()) / s.rolling(30, min_periods=5).std().replace(0, np.nan)).fillna(0).to_numpy()
    want[s.rolling(30, min_periods=5).apply(lambda v: np.nanmax(v) - np.nanmin(v)).to_numpy() == 0] = 0
    assert np.allclose(got, want, atol=1e-9)
