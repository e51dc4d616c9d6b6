"""A stream driven to completion equals the batch result; state continues across micro-batches."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from panelspark.streaming import bars as sb, quotes as sq
from panelspark.streaming.state import running_average

TICK = "symbol string, ts timestamp, event_id long, price double"


@pytest.fixture
def tick_files(spark, tmp_path):
    r = np.random.default_rng(0)
    n, start = 400, dt.datetime(2024, 1, 1)
    ts = [start + dt.timedelta(seconds=int(s)) for s in np.sort(r.integers(0, 6 * 3600, n))]
    pdf = pd.DataFrame({"symbol": r.choice(["a", "b"], n, p=[0.8, 0.2]), "ts": ts, "event_id": range(n), "price": r.normal(10, 1, n)})
    path = str(tmp_path / "ticks")
    for part in (pdf.iloc[:200], pdf.iloc[200:]):  # two files, read as two micro-batches
        spark.createDataFrame(part, TICK).coalesce(1).write.mode("append").parquet(path)
    return path, pdf


def drain(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / (name + "_ck")))
    q.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(str(tmp_path / name))


def source(spark, path):
    return spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(path)


def test_tumbling_bars_equal_batch_minus_open_tail(spark, tmp_path, tick_files):
    path, pdf = tick_files
    got = drain(sb.tumbling_bars(source(spark, path)), tmp_path, "bars").toPandas()
    batch = sb.tumbling_bars(spark.read.schema(TICK).parquet(path)).toPandas()
    closed = batch[batch["ts"] + pd.Timedelta(hours=1) <= pdf["ts"].max() - pd.Timedelta(minutes=10)]
    key = ["symbol", "ts"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), closed.sort_values(key).reset_index(drop=True), check_dtype=False)


def test_duplicates_are_dropped(spark, tmp_path, tick_files):
    path, pdf = tick_files
    spark.createDataFrame(pdf.iloc[380:], TICK).coalesce(1).write.mode("append").parquet(path)
    got = drain(sb.unique_snapshots(source(spark, path), "2 hours", ("symbol", "ts", "event_id")), tmp_path, "uniq")
    assert got.count() == len(pdf)


def test_running_average_continues_over_batches(spark, tmp_path, tick_files):
    path, pdf = tick_files
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = drain(running_average(source(spark, path), span=9), tmp_path, "avg").toPandas().sort_values("event_id")
    # the two files may arrive in either order: replay in arrival order
    want = {}
    for sym, g in got.sort_values(["symbol", "n"]).groupby("symbol"):
        e = g["price"].ewm(span=9, adjust=False).mean()
        want.update(dict(zip(g["event_id"], e, strict=True)))
    assert len(got) == len(pdf) and np.allclose(got["ewm"], [want[i] for i in got["event_id"]])


def test_polls_and_drift(spark, tmp_path):
    snap = "symbol string, ts timestamp, price double"
    t = dt.datetime(2024, 1, 3, 10)
    rows = [("a", t, 90.0), ("b", t, 101.0), ("c", t, 5.0)]
    path = str(tmp_path / "snap")
    spark.createDataFrame(rows, snap).write.json(path)
    base = spark.createDataFrame([("a", dt.date(2024, 1, 2), 100.0, "up", True), ("b", dt.date(2024, 1, 2), 100.0, "up", True)],
                                 "symbol string, base_date date, base_close double, direction string, available boolean")
    d = {r["symbol"]: r["drift"] for r in sq.drift_state(spark.createDataFrame(rows, snap), base).collect()}
    assert d == {"a": "stale", "b": "intact", "c": "unknown"}
    s = spark.readStream.schema(snap).json(path)
    sq.run_polls(sq.drift_state(s, base), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/summary"))
    assert {r["drift"]: r["snapshots"] for r in got.collect()} == {"stale": 1, "intact": 1, "unknown": 1}


def test_a_poll_that_runs_again_replaces_its_rows(spark, tmp_path):
    base = spark.createDataFrame([("A", dt.date(2024, 1, 1), 10.0, "up", True)], "symbol string, base_date date, base_close double, direction string, available boolean")
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"symbol": "A", "ts": "2024-01-02T10:00:00", "price": 9.0}\n')
    out, ck = tmp_path / "out", tmp_path / "ck"
    sq.run_polls(sq.drift_state(sq.snapshot_stream(spark, str(src)), base), str(out), str(ck)).awaitTermination()
    (ck / "commits" / "0").unlink()  # the poll wrote its rows, then the driver was lost
    (ck / "commits" / ".0.crc").unlink(missing_ok=True)
    sq.run_polls(sq.drift_state(sq.snapshot_stream(spark, str(src)), base), str(out), str(ck)).awaitTermination()
    assert spark.read.parquet(str(out / "snapshots")).count() == 1 and spark.read.parquet(str(out / "summary")).count() == 1


def test_first_snapshot_of_a_key(spark):
    rows = [("A", 1, 5, 3.0), ("A", 1, 4, 7.0), ("A", 2, 1, 1.0)]
    got = sb.unique_snapshots(spark.createDataFrame(rows, "symbol string, ts int, event_id int, price double")).orderBy("ts").collect()
    assert [(r["event_id"], r["price"]) for r in got] == [(4, 7.0), (1, 1.0)]


def test_session_filter(spark):
    rows = [(dt.datetime(2024, 1, 2, 11, 30),), (dt.datetime(2024, 1, 2, 12, 0),), (dt.datetime(2024, 1, 6, 10, 0),)]
    assert sq.in_session(spark.createDataFrame(rows, "ts timestamp")).count() == 1
    assert sq.change_pct(spark.createDataFrame([(1.0, 0.0)], "price double, prev_close double")).first()["change_pct"] == 0.0
