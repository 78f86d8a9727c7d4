"""Exact sliding counts in the stream.

``groupBy(window)`` counts whole minutes; the rules count the ``width``
seconds before each event.  Here a key keeps its seconds in state and a
second is settled when the watermark has passed it, so everything before it
has arrived: the stream then gives the rows that the batch operators
``windows.sliding_counts`` and ``windows.trailing_failures`` give over the
same lines, in whatever order these come, as long as they are not later than
the watermark allows.

Lines are added up per (key, second) in each task before the shuffle, so a
hot client sends one row a second and task.  State per key: its seconds of
the last ``width`` plus the delay of the watermark; event-time timers settle
and clear it.  The state store must be RocksDB (:func:`use_state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import windows as win

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """The state store that arbitrary state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def per_second(events: DataFrame, keys: list[str], delay: str, values: tuple[str, ...] = ("n",)) -> DataFrame:
    """(keys, sec, values, ts): events added up per key and second within each task.

    Without ``n`` among the columns every event counts one.  Events without a
    time are left out.
    """
    if "n" not in events.columns:
        events = events.withColumn("n", F.lit(1).cast("bigint"))
    known = events.filter(F.col("ts_s").isNotNull()).select(*keys, F.col("ts_s").cast("bigint").alias("sec"), *values)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.groupby([*keys, "sec"], as_index=False, dropna=False)[list(values)].sum()

    return (known.mapInPandas(add_up, known.schema).withColumn("ts", F.timestamp_seconds("sec"))
            .withWatermark("ts", delay))


class SlidingCounts(StatefulProcessor):
    """Per key: the events of each second and of the ``width`` seconds before it."""

    def __init__(self, width: int, names: list[str]):
        self.width, self.names = width, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the seconds that count, how many events each has, and up to where they are settled
        self.state = handle.getValueState("seconds", "secs array<bigint>, counts array<bigint>, settled bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get()
        counts = dict(zip(old[0], old[1])) if old else {}
        settled = old[2] if old else -2 ** 62
        for pdf in rows:
            for sec, n in zip(pdf["sec"].tolist(), pdf["n"].tolist()):
                if sec > settled:  # else later than the watermark allows
                    counts[sec] = counts.get(sec, 0) + n
                    self.handle.registerTimer((sec + 1) * 1000)
        if counts:
            secs = sorted(counts)
            self.state.update((secs, [counts[s] for s in secs], settled))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = self.state.get()
        if not old:
            return
        secs, ns, settled = old
        until = expiredTimerInfo.getExpiryTimeInMs() // 1000 - 1
        out, first, total, at = [], 0, 0, 0
        for at, (sec, n) in enumerate(zip(secs, ns)):
            if sec > until:
                break
            while secs[first] < sec - self.width:
                total -= ns[first]
                first += 1
            if sec > settled:
                out.append((*key, sec, n, total))
            total += n
        keep = [i for i, s in enumerate(secs) if s >= until - self.width]
        if keep:
            self.state.update(([secs[i] for i in keep], [ns[i] for i in keep], max(settled, until)))
            if secs[keep[-1]] <= until:  # nothing waits: look again when the last second has left the window
                self.handle.registerTimer((secs[keep[-1]] + self.width + 2) * 1000)
        else:
            self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def stream_sliding_counts(events: DataFrame, keys: list[str], width: int = win.SLIDING_WINDOW_SECONDS,
                          delay: str = "10 minutes") -> DataFrame:
    """The streaming form of ``windows.sliding_counts``: (keys, sec, n, prev), once each second is settled."""
    seconds = per_second(events, keys, delay)
    out = StructType([seconds.schema[k] for k in keys] + [StructField(c, LongType()) for c in ("sec", "n", "prev")])
    return seconds.groupBy(*keys).transformWithStateInPandas(
        SlidingCounts(width, [*keys, "sec", "n", "prev"]), out, "Append", "EventTime")


class ActiveClients(StatefulProcessor):
    """Per client: +1 when it becomes active, -1 when ``width`` seconds have passed since its last failure."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "secs array<bigint>, counts array<bigint>")
        self.last = handle.getValueState("last", "sec bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.waiting.get()
        counts = dict(zip(old[0], old[1])) if old else {}
        passed = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            for sec, n in zip(pdf["sec"].tolist(), pdf["n"].tolist()):
                if (sec + 1) * 1000 > passed:
                    counts[sec] = counts.get(sec, 0) + n
                    self.handle.registerTimer((sec + 1) * 1000)
        if counts:
            secs = sorted(counts)
            self.waiting.update((secs, [counts[s] for s in secs]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() // 1000 - 1
        old, known = self.waiting.get(), self.last.get()
        last = known[0] if known else None
        out, secs, ns = [], list(old[0]) if old else [], list(old[1]) if old else []
        while secs and secs[0] <= until:
            sec, n = secs.pop(0), ns.pop(0)
            if last is not None and last + self.width < sec:
                out.append((last + self.width + 1, 0, -1))
                last = None
            out.append((sec, n, 1 if last is None else 0))
            last = sec
            self.handle.registerTimer((sec + self.width + 2) * 1000)
        if last is not None and last + self.width < until and not (secs and secs[0] <= last + self.width):
            out.append((last + self.width + 1, 0, -1))
            last = None
        self.waiting.update((secs, ns)) if secs else self.waiting.clear()
        self.last.update((last,)) if last is not None else self.last.clear()
        if out:
            # all clients send the seconds that one watermark settles in one batch, marked by that
            # watermark; rows must be newer than it
            pdf = pd.DataFrame(out, columns=["sec", "n", "step"])
            pdf["ts"] = pd.to_datetime(timerValues.getCurrentWatermarkInMs() + 1, unit="ms", utc=True)
            yield pdf.assign(all=0)

    def close(self) -> None:
        pass


class TrailingFailures(StatefulProcessor):
    """Over all clients: failures and active clients of the trailing window, second by second."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "seconds", "secs array<bigint>, counts array<bigint>, steps array<bigint>, settled bigint, active bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get()
        found = {s: [n, d] for s, n, d in zip(old[0], old[1], old[2])} if old else {}
        settled, active = (old[3], old[4]) if old else (-2 ** 62, 0)
        for pdf in rows:
            for sec, n, step in zip(pdf["sec"].tolist(), pdf["n"].tolist(), pdf["step"].tolist()):
                at = found.setdefault(sec, [0, 0])
                at[0] += n
                at[1] += step
            if len(pdf):
                # the next watermark says that nothing more comes for what this one has settled
                self.handle.registerTimer(round(pdf["ts"].max().timestamp() * 1000))
        if found:
            secs = sorted(found)
            self.state.update((secs, [found[s][0] for s in secs], [found[s][1] for s in secs], settled, active))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = self.state.get()
        if not old:
            return
        secs, ns, steps, settled, active = old
        until = (expiredTimerInfo.getExpiryTimeInMs() - 1) // 1000 - 1
        out, first, total = [], 0, 0
        for sec, n, step in zip(secs, ns, steps):
            if sec > until:
                break
            while secs[first] < sec - self.width:
                total -= ns[first]
                first += 1
            total += n
            if sec > settled:
                active += step
                if n:
                    out.append((sec, total, active))
        keep = [i for i, s in enumerate(secs) if s >= until - self.width]
        self.state.update(([secs[i] for i in keep], [ns[i] for i in keep], [steps[i] for i in keep],
                           max(settled, until), active))
        if out:
            yield pd.DataFrame(out, columns=["ts_s", "w_failures", "w_ips"])

    def close(self) -> None:
        pass


def stream_trailing_failures(failures: DataFrame, width: int = win.DISTRIBUTED_WINDOW_SECONDS,
                             delay: str = "10 minutes") -> DataFrame:
    """The streaming form of ``windows.trailing_failures``: (ts_s, w_failures, w_ips).

    A client is two numbers in the state of its own key: the seconds that
    wait for the watermark and its last failure.  The state over all clients
    holds counts per second and no client; it gets one row a second and task.
    """
    seconds = per_second(failures, ["ip"], delay)
    steps = seconds.groupBy("ip").transformWithStateInPandas(
        ActiveClients(width), "sec bigint, n bigint, step bigint, ts timestamp, all int", "Append", "EventTime",
        eventTimeColumnName="ts")
    return steps.groupBy("all").transformWithStateInPandas(
        TrailingFailures(width), "ts_s bigint, w_failures bigint, w_ips bigint", "Append", "EventTime")
