"""Hosts that fail, as keyed state with a time to live: a stream of failures remembers a host's latest one until its time is over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A host's state after a change: its latest failure, or that it is forgotten.
CHANGE = T.StructType([T.StructField("host", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("seen_at", T.TimestampType()), T.StructField("live", T.BooleanType())])
_STATE = T.StructType([T.StructField("micros", T.LongType()), T.StructField("kind", T.StringType())])
#: The state store that keyed state with timers needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Latest(StatefulProcessor):
    """A host's state is one row: the time and kind of its latest failure. A timer stands at the end of its time."""

    def __init__(self, ttl_seconds: int) -> None:
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", _STATE)

    def _row(self, key, micros: int, kind: str | None, live: bool) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "kind": [kind], "seen_at": [pd.Timestamp(micros, unit="us", tz="UTC")], "live": [live]})

    def _end(self, micros: int) -> int:
        return -(-(micros + self.ttl) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.latest.get() if self.latest.exists() else None
        best = before = (held[0], held[1]) if held is not None else None
        for b in rows:
            for micros, kind in zip(b["micros"], b["kind"], strict=True):
                best = (int(micros), kind) if best is None or (int(micros), kind or "") > (best[0], best[1] or "") else best
        # a failure whose time was over before it came is none
        if best is None or best == before or self._end(best[0]) <= timerValues.getCurrentWatermarkInMs():
            return
        if before is not None:
            self.handle.deleteTimer(self._end(before[0]))
        self.latest.update(best)
        self.handle.registerTimer(self._end(best[0]))
        yield self._row(key, best[0], best[1], True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.latest.get() if self.latest.exists() else None
        if held is not None:
            self.latest.clear()
            yield self._row(key, held[0], held[1], False)

    def close(self) -> None:
        pass


def live_hosts(failures: DataFrame, ttl_seconds: int = 900, late: str = "0 seconds") -> DataFrame:
    """(host, kind, seen_at, live): changes of hosts in a stream of failures (host string, kind, seen_at), as they happen.

    A host's row is its latest failure, of equal times the one with the larger kind. When event time has passed it by ttl_seconds, a row that is not live
    follows and its state is dropped; event time is the latest failure of any host less `late`. The latest change of each host, if it is
    live, is what jobs.live_hosts gives for the failures so far. Null hosts and times take no part. The session's state store must be the one of PROVIDER.
    """
    spark = failures.sparkSession
    if spark.conf.get(PROVIDER[0], None) != PROVIDER[1]:
        raise ValueError(f"{PROVIDER[0]} must be {PROVIDER[1]}")
    known = failures.where("host is not null and seen_at is not null").withWatermark("seen_at", late)
    rows = known.selectExpr("cast(host as string) as host", "cast(kind as string) as kind", "unix_micros(seen_at) as micros", "seen_at")
    return rows.groupBy("host").transformWithStateInPandas(_Latest(ttl_seconds), CHANGE, "update", "EventTime")
