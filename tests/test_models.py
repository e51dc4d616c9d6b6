"""Model scoring keeps every row; walk-forward runs on short panels."""

import numpy as np
import pandas as pd

from panelspark.operators import models as ml


def panel(n):
    r = np.random.default_rng(1)
    x = r.normal(size=n)
    return pd.DataFrame({"symbol": "A", "date": pd.bdate_range("2022-01-03", periods=n).date, "x": x, "z": r.normal(size=n), "target": (x + 0.1 * r.normal(size=n) > 0).astype(int), "_fwd_ret": x})


def test_rows_with_a_missing_feature_keep_a_null_score(spark):
    df = spark.createDataFrame(panel(40))
    m = ml.train(df, ["x", "z"], kind="logistic")
    rows = spark.createDataFrame([(1, 0.5, 0.1), (2, None, 0.1), (3, float("nan"), 0.0)], "id int, x double, z double")
    got = {r["id"]: r["p_up"] for r in ml.score(m, rows).collect()}
    assert got[1] > 0.5 and got[2] is None and got[3] is None and len(got) == 3


def test_short_panel_has_fewer_folds(spark):
    s = ml.walk_forward_scores(spark.createDataFrame(panel(60)), ["x", "z"], folds=3, kind="logistic")
    assert s.select("fold").distinct().count() >= 1 and s.filter("p_up is null").count() == 0
