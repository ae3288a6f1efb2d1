"""The state of runs from a stream of their events: latest event, stalled runs, forgotten runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "run string, ts timestamp, done long, total long, status string, kind string"
#: Statuses after which a run is over: it can't stall.
OVER = {"completed", "failed", "stopped"}


def use_state_store(spark: SparkSession) -> None:
    """State with timers needs the store that keeps them; queries that are started later use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Run(StatefulProcessor):
    """One row of state per run. A timer at the time of its latest event plus a while says that it stalled, a later one that
    it is forgotten. An event that arrives late leaves a newer one in place."""

    def __init__(self, stalled_ms: int, forget_ms: int):
        self.stalled_ms, self.forget_ms = stalled_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "ms long, done long, total long, status string, stalled boolean")

    def _row(self, key, kind: str, ms, done, total, status) -> pd.DataFrame:
        columns = {"run": [key[0]], "ts": [pd.Timestamp(ms, unit="ms")], "done": [done], "total": [total], "status": [status], "kind": [kind]}
        return pd.DataFrame(columns).astype({"done": "Int64", "total": "Int64"})

    def _timers(self, *wanted: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        for ms in wanted:
            self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.latest.get() if self.latest.exists() else None
        best = held
        for batch in rows:
            for r in batch.itertuples(index=False):
                if pd.isna(r.ts):
                    continue
                plain = lambda v: None if pd.isna(v) else int(v)
                new = (int(r.ts.timestamp() * 1000), plain(r.done), plain(r.total), None if pd.isna(r.status) else r.status, False)
                if best is None or _order(new) > _order(best):
                    best = new
        if best is None or best is held:
            return
        self.latest.update(best)
        ends = best[0] + self.forget_ms
        self._timers(*([ends] if best[3] in OVER else [best[0] + self.stalled_ms, ends]))
        yield self._row(key, "event", *best[:4])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.latest.exists():
            return
        ms, done, total, status, stalled = self.latest.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at >= ms + self.forget_ms:
            self.latest.clear()
        elif not stalled and status not in OVER:
            self.latest.update((ms, done, total, status, True))
            yield self._row(key, "stalled", ms, done, total, status)

    def close(self) -> None:
        pass


def _order(state: tuple) -> tuple:
    """Later events are greater; of events at one time the one that got further."""
    ms, done, total, status, _ = state
    return ms, -1 if done is None else done, -1 if total is None else total, status or ""


def run_progress(events: DataFrame, watermark: str = "1 hour", stalled_seconds: int = 600, forget_seconds: int = 86_400) -> DataFrame:
    """A row (kind `event`) whenever the latest event of a run changes, and one (kind `stalled`) when no newer event came
    for stalled_seconds and the run isn't over.

    Events (run, ts, done, total, status) may come out of order within the watermark; later ones are dropped. A run without
    events for forget_seconds leaves the state, so state is bounded by the runs of that time. Null times are ignored; events
    of a null run are one run. Call use_state_store first.
    """
    rows = events.select("run", "ts", "done", "total", "status").withWatermark("ts", watermark)
    return rows.groupBy("run").transformWithStateInPandas(_Run(stalled_seconds * 1000, forget_seconds * 1000), outputStructType=OUT, outputMode="append", timeMode="eventTime")
