"""File sources and sinks round trips, cleaning rules, SQL functions."""

import datetime as dt
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import scalar as fx
from panelspark.operators import cleaning as cl
from panelspark.schema import required_columns
from panelspark.sources import quotes, readers


def test_read_bars_dedupes_and_names_symbols(spark, tmp_path):
    d = tmp_path / "bars"
    d.mkdir()
    (d / "600519.SH.csv").write_text("date,open,high,low,close,volume\n2024-01-02,1,2,1,2,10\n2024-01-01,1,1,1,1,5\n2024-01-02,1,2,1,2,10\n")
    (d / "RB.SHF.csv").write_text("date,open,high,low,close,volume\n2024-01-01,3,3,3,3,7\n")
    b = readers.read_bars(spark, str(d)).toPandas()
    assert len(b) == 3 and b["symbol"].nunique() == 2
    assert readers.load_pool(spark, str(d), "2024-01-01", None, 2).select("symbol").distinct().count() == 1


@pytest.mark.parametrize("closes", [(1.0, 9.0), (9.0, 1.0)])
def test_first_duplicate_is_kept(spark, tmp_path, closes):
    rows = "".join(f"2024-01-{1 + i % 28:02d},1,1,1,{closes[i // 28]},5\n" for i in range(56))
    (tmp_path / "A.csv").write_text("date,open,high,low,close,volume\n" + rows)
    assert {r["close"] for r in readers.read_bars(spark, str(tmp_path)).collect()} == {closes[0]}
    m = tmp_path / "macro"
    m.mkdir()
    (m / "macro_x.csv").write_text("date,value\n" + "".join(f"2024-01-31,{c}\n" for c in closes))
    assert [r["value"] for r in readers.read_macro(spark, str(m)).collect()] == [closes[0]]


def test_read_macro_takes_first_and_skips_bad_rows(spark, tmp_path):
    (tmp_path / "macro_cpi.csv").write_text("date,value\n2024-01-31,1.5\n2024-02-29,n/a\n2024-03-31,2.5\n")
    m = readers.read_macro(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r["indicator"], r["value"]) for r in m] == [("cpi", 1.5), ("cpi", 2.5)]


def test_snapshot_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("A", dt.datetime(2024, 1, d, 10), 1.0 * d, 1.0, 1.0, 1.0, 1.0, 5.0) for d in (1, 2, 3)]
    s = spark.createDataFrame(rows, readers.SNAPSHOT)
    readers.append_snapshots(s, path)
    readers.append_snapshots(s.limit(1).withColumn("symbol", F.lit("B")), path)
    day = os.path.join(path, "day=2024-01-02", "bad.json")
    with open(day, "w") as f:
        f.write('{"symbol": "A", "ts": \n')
    got = readers.read_snapshots(spark, path)
    assert got.filter("symbol is not null").count() == 4
    assert readers.read_snapshots(spark, path, day="2024-01-02", symbol="A").count() == 1
    assert readers.retained(got.filter("symbol is not null"), "2024-01-03", 1).count() == 2


def test_prediction_log_rejects_nameless_rows(spark, tmp_path):
    ok = spark.createDataFrame([("A", 5)], "symbol string, horizon int")
    readers.append_predictions(ok, str(tmp_path / "p"))
    readers.append_predictions(ok, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    with pytest.raises(Exception, match="without symbol"):
        readers.append_predictions(spark.createDataFrame([("", 5)], "symbol string, horizon int"), str(tmp_path / "p"))


def test_column_store_and_feed_export(spark, tmp_path):
    b = spark.createDataFrame(pd.DataFrame({"symbol": ["A", "A", "B"], "date": [dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 2)],
                                            **{c: [1.0, 2.0, 3.0] for c in ("open", "high", "low", "close", "volume")}}))
    readers.write_column_store(b, str(tmp_path / "cs"))
    assert spark.read.parquet(str(tmp_path / "cs/values")).filter("field = 'close' and symbol = 'B'").first()["ordinal"] == 1
    feed = b.groupBy("symbol").agg(F.collect_list(F.struct("date", "close")).alias("orders"))
    readers.export_feed(feed, str(tmp_path / "feed"))
    assert spark.read.option("header", True).csv(str(tmp_path / "feed/csv")).count() == 3


def test_fresh_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "c"))
    assert readers.fresh_files(spark, str(tmp_path / "c"), 60, "2000-01-01 00:00:00").count() == 3
    assert readers.fresh_files(spark, str(tmp_path / "c"), 60, "2100-01-01 00:00:00").count() == 0


def test_quote_line_and_array_rows(spark):
    fields = ["1", "name", "600519", "10.5", "10.0", "10.1", "900"] + [""] * 26 + ["10.9", "9.9"]
    line = f'v_sh600519="{"~".join(fields)}";v_sz000001="1~n~c~x~1";'
    r = quotes.parse_quotes(spark.createDataFrame([(line,)], "value string")).collect()
    assert len(r) == 1 and r[0]["price"] == 10.5 and r[0]["high"] == 10.9 and r[0]["low"] == 9.9
    a = quotes.parse_array_rows(spark.createDataFrame([('[["2024-01-02","1","2","3","0.5","x"]]',)], "payload string")).first()
    assert a["close"] == 2.0 and a["volume"] is None


def test_headers_fill_and_contracts(spark):
    raw = spark.createDataFrame([("A", "2024-01-01", "1.5", "0"), ("A", "bad", "2", "0")], ["symbol", "日期", "收盘", "成交量"])
    n = cl.normalise_headers(raw).orderBy("close").collect()
    assert n[0]["volume"] == 1.0 and n[1]["date"] is None
    with pytest.raises(ValueError):
        required_columns(raw, ["close"])
    with pytest.raises(ValueError):
        cl.align_features(raw.withColumn("date", F.lit(1)), ["x"], strict=True)
    with pytest.warns(UserWarning):
        assert cl.feature_columns(spark.createDataFrame([(1, 1, 1, 1)], ["symbol", "_fwd_ret", "target_5d", "my_fwd"])) == ["my_fwd"]
    want = {"ret_5": "returns", "kama": "kama", "zz": "uncovered", "aroon_up": "momentum", "x_macd": "macd", "my_rsi": "rsi", "old_atr": "volatility", "hist_volume_ratio": "volume", "dema_5": "trend_extra", "ma_5": "ma"}
    assert cl.group_features(list(want)) == want
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in want], "feature string").select("feature", cl.feature_family()).collect()}
    assert got == want
    assert cl.subset_features(list(want), "classic_only") == ["ret_5", "x_macd", "my_rsi", "old_atr", "hist_volume_ratio", "ma_5"] and set(cl.subset_features(list(want), "full")) == set(want) - {"zz"}
    assert cl.subset_features(["ret_5", "kama", "obv"], "compact") == ["ret_5", "obv"]


def test_asset_classes(spark):
    cases = {"600519.sh": "stock", "510300.SH": "etf", "RB.SHF": "futures", "USDCNH.FXCM": "forex", "113001.SH": "convertible", "AAPL.US": "unknown", "@": "unknown"}
    df = spark.createDataFrame([(k,) for k in cases], "symbol string").select("symbol", fx.asset_class().alias("c"))
    assert {r["symbol"]: r["c"] for r in df.collect()} == cases


def test_sql_functions(spark):
    names = fx.register_sql(spark)
    assert "panel_confidence" in names
    r = spark.sql("select panel_confidence(0.75) a, panel_net_up('down', 0.6) b, panel_market_code(' 600519.sh') c, panel_trading_hours(timestamp '2024-01-02 11:30:00') d").first()
    assert r["a"] == 0.5 and abs(r["b"] - 0.4) < 1e-12 and r["c"] == "sh600519" and r["d"]
