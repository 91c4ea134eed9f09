"""Life of a listing as a stream sees it: SEEN, ENRICHED, and GONE when it hasn't been sighted for a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "k string, event string, at timestamp"


#: Groups of listings, by hash: one has one row of state and one timer, so calls to the state store don't grow with the listings.
GROUPS = 256


class Lifecycle(StatefulProcessor):
    """Keeps for each listing of a group when it was last sighted and with what content; a timer of event time says when the first of them is gone.

    A sight in time only moves the time. Sights of one micro-batch are taken in order of time; one that comes ``away`` or more after the sight before it
    finds the listing gone and sees it anew, whether or not the timer has fired, so events don't depend on how the
    stream is cut into micro-batches. What is gone holds no state."""

    def __init__(self, away_ms: int):
        self.away = away_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sights = handle.getValueState("sights", "due long, held binary")

    def _held(self) -> tuple[int | None, pd.DataFrame]:
        """The registered timer, and (k, ms, content) of the group's listings."""
        if not self.sights.exists():
            return None, pd.DataFrame({"k": pd.Series(dtype=object), "ms": pd.Series(dtype="int64"), "content": pd.Series(dtype=object)})
        due, held = self.sights.get()
        return due, pa.ipc.open_stream(held).read_pandas()

    def _keep(self, before: int | None, held: pd.DataFrame) -> None:
        due = int(held["ms"].min()) + self.away if len(held) else None
        if before is not None and before != due:
            self.handle.deleteTimer(before)
        if due is None:
            self.sights.clear()
            return
        if before != due:
            self.handle.registerTimer(due)
        sink = pa.BufferOutputStream()
        table = pa.table({"k": pa.array(held["k"], pa.string(), from_pandas=True), "ms": pa.array(held["ms"], pa.int64()), "content": pa.array(held["content"], pa.string(), from_pandas=True)})
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        self.sights.update((due, sink.getvalue().to_pybytes()))

    def _out(self, parts: list[tuple[str, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        parts = [pd.DataFrame({"k": k, "event": event, "at": pd.to_datetime(ms, unit="ms", utc=True)}) for event, k, ms in parts if len(k)]
        if parts:
            yield pd.concat(parts, ignore_index=True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # All sights of one group in this micro-batch.
        before, held = self._held()
        fresh = pd.concat(list(rows))[["k", "ms", "nth", "content"]]
        own = pd.concat([held.assign(nth=0, fresh=False), fresh.assign(fresh=True)], ignore_index=True)
        own["who"], own["what"] = (pd.factorize(own[c], use_na_sentinel=False)[0] for c in ("k", "content"))
        own = own.sort_values(["who", "fresh", "ms", "nth"], kind="stable", ignore_index=True)
        follows = own["who"].eq(own["who"].shift())
        last = own["ms"].shift(fill_value=0)
        gone = follows & (own["ms"] - last >= self.away)
        seen = own["fresh"] & (~follows | gone)
        changed = follows & ~gone & own["what"].ne(own["what"].shift())
        self._keep(before, own[~own["who"].eq(own["who"].shift(-1))][["k", "ms", "content"]])
        yield from self._out([("GONE", own["k"][gone], last[gone] + self.away), ("SEEN", own["k"][seen], own["ms"][seen]), ("ENRICHED", own["k"][changed], own["ms"][changed])])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, held = self._held()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        gone = held["ms"] + self.away <= now
        # Spark deletes the timer that has fired.
        self._keep(None, held[~gone])
        yield from self._out([("GONE", held["k"][gone], held["ms"][gone] + self.away)])

    def close(self) -> None:
        pass


def lifecycle(sights: DataFrame, away_ms: int, delay: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """Events (k, event, at) of a stream of sights (k, ts, nth, content): ``nth`` orders those of one moment. Sights later than ``delay`` are dropped."""
    stamped = sights.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    grouped = stamped.withColumn("__group", F.pmod(F.xxhash64("k"), F.lit(groups)))
    return grouped.groupBy("__group").transformWithStateInPandas(Lifecycle(away_ms), EVENTS, "Append", "EventTime")


class with_provider:
    """Sets the state store that this needs, and what was set before afterwards."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(self.KEY)
        self.spark.conf.set(self.KEY, PROVIDER)

    def __exit__(self, *_):
        self.spark.conf.set(self.KEY, self.before)
