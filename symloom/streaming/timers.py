"""Debouncing with an early trigger: keyed state and event-time timers.

A burst of changes of one path is over ``gap`` after its last event; a request at once (a flush, or the path's removal)
ends it there and then, and cancels its timer. The same rule exists for a batch, as windows.

The rule, for both: events of one path in the order of their times, a request after the changes of its own time; a
change opens or extends a burst; a burst ends at its last change plus ``gap`` if no event comes until then (one that
comes just then still extends it); a request fires whatever is pending, and fires even if nothing is. A stream learns
of events late: what a request covers (events up to its time) is done with, whenever it arrives, for a file that is
read again is read as it is. Events behind the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: Operations that do not wait.
AT_ONCE = ("flush", "unlink")
FIRED = "fire_ts timestamp, reason string, op string"


def debounce_flush(feed: DataFrame, key: str, ts: str, op: str, gap_seconds: float, at_once: tuple[str, ...] = AT_ONCE) -> DataFrame:
    """(key, fire_ts, reason, op): on a batch, when each burst of a key fires, why (``quiet`` or the request) and its last change, if any.

    Rows with a null key or time, and copies of an event, count for nothing; of several requests of one time the first by name counts.
    """
    request = F.col(op).isin(*at_once)
    events = feed.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(op).isNotNull()).select(key, F.col(ts).alias("at"), F.col(op).alias("what"), request.alias("request")).distinct()
    first = events.where("request").groupBy(key, "at", "request").agg(F.min("what").alias("what")).select(key, "at", "what", "request")
    events = events.where("not request").unionByName(first)
    by = Window.partitionBy(key).orderBy("at", "request", "what")
    micros = F.unix_micros("at")
    cut = F.lag("request").over(by) | (micros - F.lag(micros).over(by) > int(gap_seconds * 1e6))
    marked = events.withColumn("cut", F.coalesce(cut.cast("int"), F.lit(0)))
    burst = F.sum("cut").over(by.rowsBetween(Window.unboundedPreceding, 0))
    change = F.when(~F.col("request"), F.struct("at", "what"))
    bursts = marked.withColumn("burst", burst).groupBy(key, "burst").agg(F.max(change).alias("last"), F.max(F.when(F.col("request"), F.struct("at", "what"))).alias("asked"))
    quiet = F.timestamp_micros(F.unix_micros("last.at") + int(gap_seconds * 1e6))
    return bursts.select(key, F.coalesce("asked.at", quiet).alias("fire_ts"), F.coalesce("asked.what", F.lit("quiet")).alias("reason"), F.col("last.what").alias("op"))


class Bursts(StatefulProcessor):
    """State of one path: its pending changes as (first, last, last change) in microseconds, and the time that requests cover.

    Changes ahead of the watermark are kept one by one, since a request may still come between them; those behind it are
    one row for each burst. One timer is set, after the earliest end of a burst or of what requests cover.
    """

    def __init__(self, gap_micros: int, at_once: tuple[str, ...]):
        self.gap, self.at_once = gap_micros, at_once

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "first long, last long, op string")
        self.covered = handle.getValueState("covered", "until long")

    def close(self) -> None:
        pass

    def _bursts(self, changes: list[tuple]) -> list[list[tuple]]:
        out = []
        for c in sorted(changes, key=lambda c: (c[1], c[2])):
            if out and c[0] - out[-1][-1][1] <= self.gap:
                out[-1].append(c)
            else:
                out.append([c])
        return out

    def _load(self) -> tuple[list[tuple], int | None]:
        return [tuple(x) for x in self.pending.get()], self.covered.get()[0] if self.covered.exists() else None

    def _store(self, changes: list[tuple], covered: int | None, watermark: int) -> None:
        kept, ends = [], []
        for burst in self._bursts(changes):
            old = [c for c in burst if c[1] <= watermark]
            kept += ([(old[0][0], *old[-1][1:])] if old else []) + burst[len(old) :]
            ends.append(burst[-1][1] + self.gap)
        if kept:
            self.pending.put(kept)
        else:
            self.pending.clear()
        if covered is None:
            self.covered.clear()
        else:
            self.covered.update((covered,))
            ends.append(covered)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if ends:
            self.handle.registerTimer(min(ends) // 1000 + 2)  # an event at the very end still counts

    def _row(self, key, at: int, reason: str, op: str | None) -> dict:
        return {"path": key[0], "fire_ts": pd.Timestamp(at, unit="us", tz="UTC"), "reason": reason, "op": op}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changes, covered = self._load()
        events, out, watermark = pd.concat(rows), [], timerValues.getCurrentWatermarkInMs() * 1000
        when = events["ts"].dt.as_unit("us").astype("int64")
        for at, request, op in sorted({(int(t), op in self.at_once, op) for t, op in zip(when, events["op"], strict=True)}):
            if at < watermark or (covered is not None and at <= covered):
                continue
            if not request:
                changes.append((at, at, op))
                continue
            op_of = None
            for burst in self._bursts([c for c in changes if c[1] <= at]):
                end = burst[-1][1] + self.gap
                if end < at:
                    out.append(self._row(key, end, "quiet", burst[-1][2]))
                else:
                    op_of = burst[-1][2]
            out.append(self._row(key, at, op, op_of))
            changes, covered = [c for c in changes if c[1] > at], at
        self._store(changes, covered, watermark)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        changes, covered = self._load()
        now, out, kept = timerValues.getCurrentWatermarkInMs() * 1000, [], []
        for burst in self._bursts(changes):
            end = burst[-1][1] + self.gap
            if end < now:
                out.append(self._row(key, end, "quiet", burst[-1][2]))
            else:
                kept += burst
        self._store(kept, covered if covered is not None and covered >= now else None, now)
        if out:
            yield pd.DataFrame(out)


def debounced_flush_stream(feed: DataFrame, gap_seconds: float = 0.3, late: str = "1 second", at_once: tuple[str, ...] = AT_ONCE) -> DataFrame:
    """(path, fire_ts, reason, op): on a stream of (path, ts, op), a row when a burst of a path is over or a request comes.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = feed.where("path is not null and ts is not null and op is not null").select("path", "ts", "op").withWatermark("ts", late)
    kind = feed.schema["path"].dataType.simpleString()
    return rows.groupBy("path").transformWithStateInPandas(Bursts(int(gap_seconds * 1e6), at_once), f"path {kind}, {FIRED}", "Append", "EventTime")
