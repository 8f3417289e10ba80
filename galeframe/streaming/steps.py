"""Steps reduced when all their members are there, with state that ends: timers of event time clear it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started meanwhile keep their state where timers and maps are to be had."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


class _Steps(StatefulProcessor):
    def __init__(self, members: int, keep_ms: int) -> None:
        self.members, self.keep_ms = members, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.have = handle.getMapState("have", "member int", "value double")
        self.done = handle.getValueState("done", "done boolean")
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(rows)
        last = int(got["t"].max().timestamp() * 1000) + self.keep_ms
        before = self.until.get()
        if before is None or last > before[0]:
            self.until.update((last,))
            self.handle.registerTimer(last)
        if self.done.exists():
            return
        for m, v in got.groupby("member")["value"].min().items():  # as many as members, whatever the rows
            known = self.have.getValue((int(m),))
            if known is None or v < known[0]:
                self.have.updateValue((int(m),), (float(v),))
        values = [v[0] for v in self.have.values()]
        if len(values) == self.members:
            self.have.clear()
            self.done.update((True,))
            yield pd.DataFrame({"step": [key[0]], "n": [len(values)], "mean": [sum(values) / len(values)], "low": [min(values)], "high": [max(values)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = self.until.get()
        if until is not None and expiredTimerInfo.getExpiryTimeInMs() >= until[0]:
            for state in (self.have, self.done, self.until):
                state.clear()
        return iter(())

    def close(self) -> None:
        pass


def expiring_steps(arrivals: DataFrame, members: int, keep_hours: float) -> DataFrame:
    """(step, n, mean, low, high), once for each step, as soon as all its members have arrived.

    ``arrivals``: a stream of (step string, member int, value double, t
    timestamp) with a watermark on ``t``. A step keeps one value for each
    member (the least of repeated deliveries) and, when it is emitted, a mark
    alone; both go when the watermark has passed its last arrival by
    ``keep_hours``, complete or not. Until then late copies don't emit a step
    again. Start the stream within ``timed_state``.
    """
    rows = arrivals.groupBy("step").transformWithStateInPandas(_Steps(members, int(keep_hours * 3_600_000)), "step string, n int, mean double, low double, high double", "Append", "EventTime")
    return rows
