"""Keyed state on a stream: a running exponential average and mean change per symbol."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "symbol string, ts timestamp, event_id long, price double, ewm double, n long"


class RunningAverage(StatefulProcessor):
    """State per symbol: last average and count.  Rows of a micro-batch are applied in event order."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("avg", "value double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value, n = self.state.get() if self.state.exists() else (None, 0)
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], kind="mergesort")
        x = pdf["price"]
        if value is not None:  # continue the recursion: prepend the stored value
            x = pd.concat([pd.Series([value]), x], ignore_index=True)
        e = x.ewm(alpha=self.alpha, adjust=False).mean()
        if value is not None:
            e = e.iloc[1:]
        out = pdf.assign(symbol=key[0], ewm=e.to_numpy(), n=range(n + 1, n + len(pdf) + 1))
        self.state.update((float(e.iloc[-1]), int(n + len(pdf))))
        yield out[["symbol", "ts", "event_id", "price", "ewm", "n"]]

    def close(self) -> None:
        pass


def running_average(ticks: DataFrame, span: int = 20, mode: str = "Append") -> DataFrame:
    """Needs the RocksDB state store on a stream (spark.sql.streaming.stateStore.providerClass)."""
    return ticks.select("symbol", "ts", "event_id", "price").groupBy("symbol").transformWithStateInPandas(
        RunningAverage(2.0 / (span + 1)), outputStructType=SCHEMA, outputMode=mode, timeMode="None")
