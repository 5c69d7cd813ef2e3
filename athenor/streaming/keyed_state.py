"""Keyed state with timers: a circuit breaker and a drift monitor whose states open, close and leave on event time.

Both need the RocksDB state store (``use_rocksdb``) and a stream with a watermark on its time column. A key's state is a few numbers, in the monitor's case a
list of at most ``window`` of them; a key that has not been heard of for ``forget`` seconds of watermark gives up its state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from athenor.params import DEFAULT

CIRCUIT = "state string, failures long, opened_at long, last long"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Forgetting(StatefulProcessor):
    """What both processors share: one row of state, and a timer that ends a key's state when it has been silent for long."""

    def __init__(self, by: str, time: str, forget: int) -> None:
        self.by, self.time, self.forget = by, time, forget

    def close(self) -> None:
        pass

    def _seconds(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        got = pd.concat(list(rows))
        return got.assign(_at=got[self.time].astype("datetime64[s]").astype("int64")).sort_values("_at", kind="stable")

    def _timer(self, at: int) -> None:
        """Only the latest timer counts; those of before are taken back."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(at * 1000)


class _Breaker(_Forgetting):
    def __init__(self, by: str, time: str, succeeded: str, failures: int, pause: int, forget: int) -> None:
        super().__init__(by, time, forget)
        self.succeeded, self.failures, self.pause = succeeded, failures, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.circuit = handle, handle.getValueState("circuit", CIRCUIT)

    def _row(self, key: Any, at: int, state: str, run: int) -> dict:
        return {self.by: key[0], "at": at, "state": state, "failures": run}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, run, opened, last = tuple(self.circuit.get()) if self.circuit.exists() else ("closed", 0, 0, 0)
        got, out = self._seconds(rows), []
        for at, fine in zip(got["_at"].tolist(), got[self.succeeded].tolist(), strict=True):
            last = max(last, at)
            if state == "open":
                if at - opened < self.pause:
                    continue  # such a call is not made
                state = "half_open"
                out.append(self._row(key, at, state, run))
            before = state
            if fine:
                state, run = "closed", 0
            else:
                run += 1
                if state == "half_open" or run >= self.failures:
                    state, opened = "open", at
            if state != before:
                out.append(self._row(key, at, state, run))
        self.circuit.update((state, run, opened, last))
        self._timer(opened + self.pause if state == "open" else last + self.forget)
        yield pd.DataFrame(out, columns=[self.by, "at", "state", "failures"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, run, opened, last = self.circuit.get()
        at = expiredTimerInfo.getExpiryTimeInMs() // 1000
        out = []
        if state == "open":  # the next call is a trial
            self.circuit.update(("half_open", run, opened, last))
            self.handle.registerTimer((max(at, last) + self.forget) * 1000)
            out.append(self._row(key, at, "half_open", run))
        else:
            self.circuit.clear()
            out.append(self._row(key, at, "forgotten", 0))
        yield pd.DataFrame(out, columns=[self.by, "at", "state", "failures"])


def circuit_breaker(stream: DataFrame, by: str, time: str, succeeded: str, failures: int = 5, pause: int = 60, forget: int = 3_600) -> DataFrame:
    """(by, at, state, failures): every change of a service's circuit, in seconds of event time.

    ``failures`` failed calls in a row open it; it is half open when the watermark has passed ``pause`` seconds or at the first call after
    them, whichever comes first; the trial closes it or opens it again. A service without calls for ``forget`` seconds is forgotten.
    """
    kind = stream.schema[by].dataType.simpleString()
    return stream.groupBy(by).transformWithStateInPandas(_Breaker(by, time, succeeded, failures, pause, forget), f"{by} {kind}, at long, state string, failures long", "append", "EventTime")


class _Drift(_Forgetting):
    def __init__(self, by: str, time: str, relevance: str, window: int, least: float, kill: float, forget: int) -> None:
        super().__init__(by, time, forget)
        self.relevance, self.window, self.least, self.kill = relevance, window, least, kill

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last, self.seen = handle, handle.getListState("last", "relevance double"), handle.getValueState("seen", "seen long, at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = self._seconds(rows)
        seen, at = tuple(self.seen.get()) if self.seen.exists() else (0, 0)
        last = [r[0] for r in self.last.get()] if self.last.exists() else []
        last = (last + got[self.relevance].fillna(0.0).tolist())[-self.window :]
        seen, at = seen + len(got), max(at, int(got["_at"].max()))
        self.last.put([(float(x),) for x in last])
        self.seen.update((seen, at))
        self._timer(at + self.forget)
        share = sum(x >= self.least for x in last) / len(last)
        yield pd.DataFrame({self.by: [key[0]], "seen": [seen], "share": [share], "stop": [len(last) >= self.window and share < self.kill]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        self.seen.clear()
        yield pd.DataFrame({self.by: [key[0]], "seen": [0], "share": [None], "stop": [False]})


def drift_monitor(stream: DataFrame, by: str, time: str, relevance: str, window: int = DEFAULT.drift_window, least: float = DEFAULT.min_bucket_relevance, kill: float = DEFAULT.drift_kill, forget: int = 3_600) -> DataFrame:
    """(by, seen, share, stop) after each batch; a key that has gone gives one last row with nothing seen."""
    kind = stream.schema[by].dataType.simpleString()
    return stream.groupBy(by).transformWithStateInPandas(_Drift(by, time, relevance, window, least, kill, forget), f"{by} {kind}, seen long, share double, stop boolean", "append", "EventTime")
