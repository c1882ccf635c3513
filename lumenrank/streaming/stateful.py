"""Streaming forms of the time-dependent operators: typed state with event-time timers, micro-batch reranking.

A key's rows are held back until the watermark has passed them and are then folded in time order, so neither the order
inside a micro-batch nor how rows are dealt over micro-batches matters: what comes out is what the batch operators
give. Rows that are later than the watermark are dropped, as Spark does. What the watermark hasn't passed when a
stream ends is held in its checkpoint for the next run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..operators.stateful import _micros

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: (times in microseconds ascending, the rows, state or None) to (new columns, new state, when it expires or None).
Fold = Callable[[np.ndarray, pd.DataFrame, tuple | None], tuple[dict[str, list], tuple, int | None]]


class InOrder(StatefulProcessor):
    """Holds a key's rows as Arrow chunks, one a micro-batch, and folds those that the watermark has passed. State of
    the fold is cleared when the watermark passes its expiry."""

    def __init__(self, fold: Fold, form: str):
        self.fold, self.form = fold, form

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.state = handle.getValueState("state", self.form)
        self.expiry = handle.getValueState("expiry", "at long")

    def _pack(self, frame: pd.DataFrame) -> tuple[bytes]:
        table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        return (sink.getvalue().to_pybytes(),)

    def _wake(self, micros: int, firing: int | None = None) -> None:
        """A timer for when the watermark has passed this time, unless one (other than that which is firing) comes first."""
        at = micros // 1000 + 1
        if not any(t <= at and t != firing for t in self.handle.listTimers()):
            self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if frames:
            frame = pd.concat(frames, ignore_index=True)
            self.held.appendValue(self._pack(frame))
            self._wake(int(frame["event_us"].min()))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        firing = expiredTimerInfo.getExpiryTimeInMs()
        passed, out = timerValues.getCurrentWatermarkInMs() * 1000, []
        chunks = [pa.ipc.open_stream(r[0]).read_pandas() for r in self.held.get()] if self.held.exists() else []
        if chunks:
            frame = pd.concat(chunks, ignore_index=True)
            ready, rest = frame[frame["event_us"] < passed], frame[frame["event_us"] >= passed]
            if len(ready):
                ready = ready.sort_values("event_us", kind="stable", ignore_index=True)
                new, state, expiry = self.fold(ready["event_us"].to_numpy(), ready, self.state.get() if self.state.exists() else None)
                self.state.update(state)
                if expiry is not None:
                    self.expiry.update((int(expiry),))
                out = [ready.drop(columns="event_us").assign(**new)]
            if len(rest):
                self.held.put([self._pack(rest)])
                self._wake(int(rest["event_us"].min()), firing)
            else:
                self.held.clear()
        if not self.held.exists() and self.expiry.exists():
            at = self.expiry.get()[0]
            if at < passed:
                self.state.clear()
                self.expiry.clear()
            else:
                self._wake(at, firing)
        return iter(out)

    def close(self) -> None:
        pass


def _folded(stream: DataFrame, key: str, ts: str, delay: str, fold: Fold, form: str, more: list[StructField]) -> DataFrame:
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)  # timers and several states a key need it
    # names that begin with an underscore don't reach the processor
    kept = stream.withWatermark(ts, delay).withColumn("event_us", F.unix_micros(F.col(ts).cast("timestamp"))).groupBy(key)
    return kept.transformWithStateInPandas(InOrder(fold, form), StructType([*stream.schema.fields, *more]), "Append", "EventTime")


def ttl_cache(stream: DataFrame, key: str, ttl_seconds: float, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The stream with hit, as ``operators.stateful.ttl_cache`` has it. State per key is the last time of writing, cleared
    when the watermark passes its expiry."""
    ttl = int(ttl_seconds * 1_000_000)

    def fold(times: np.ndarray, rows: pd.DataFrame, state: tuple | None):
        at, hits = (state[0] if state else None), []
        for t in times.tolist():
            hits.append(at is not None and t - at < ttl)
            at = at if hits[-1] else t
        return {"hit": hits}, (at,), at + ttl

    return _folded(stream, key, ts, delay, fold, "at long", [StructField("hit", BooleanType())])


def breaker(stream: DataFrame, failed: str, window: str, threshold: int, key: str, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The stream with failures and open per key, as ``operators.stateful.breaker`` has them. State per key are the
    different times of failures in the trailing window, with their numbers."""
    span = _micros(window)

    def fold(times: np.ndarray, rows: pd.DataFrame, state: tuple | None):
        now, counts = np.unique(times[rows[failed].fillna(False).to_numpy(bool)], return_counts=True)
        before, held = (np.array(state[0], np.int64), np.array(state[1], np.int64)) if state and state[0] else (np.empty(0, np.int64),) * 2
        at, n = np.concatenate((before, now)), np.concatenate((held, counts))  # those of earlier folds are earlier
        total = np.concatenate(([0], np.cumsum(n)))
        seen = total[np.searchsorted(at, times, "right")] - total[np.searchsorted(at, times - span, "left")]
        live = at >= times[-1] - span
        return {"failures": seen.tolist(), "open": (seen >= threshold).tolist()}, (at[live].tolist(), n[live].tolist()), int(times[-1]) + span

    return _folded(stream, key, ts, delay, fold, "at array<long>, n array<long>", [StructField("failures", LongType()), StructField("open", BooleanType())])


def budget(stream: DataFrame, latency: str, most: float, key: str, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The stream with spent and skipped per key, as ``operators.stateful.budget`` has them in the order of time (rows
    of one time: as they come). State per key is the sum so far; a key's budget has no end, and nor has its state."""

    def fold(times: np.ndarray, rows: pd.DataFrame, state: tuple | None):
        took = rows[latency].astype(float).fillna(0.0).to_numpy()
        before = (state[0] if state else 0.0) + np.concatenate(([0.0], np.cumsum(took)))
        return {"spent": before[:-1].tolist(), "skipped": (before[:-1] > most).tolist()}, (float(before[-1]),), None

    return _folded(stream, key, ts, delay, fold, "spent double", [StructField("spent", DoubleType()), StructField("skipped", BooleanType())])


def failure_counts(stream: DataFrame, failed: str, window: str, slide: str, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Failures per sliding window, final once the watermark has passed it."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, window, slide)).agg(F.count_if(failed).alias("failures"), F.count("*").alias("events"))


def rerank_stream(requests: DataFrame, rerank: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Request rows reranked micro-batch by micro-batch. ``rerank`` is called anew for each batch, so a policy
    store that it reads notices changed files between batches. Returns the started query."""
    return requests.writeStream.foreachBatch(lambda batch, n: sink(rerank(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
