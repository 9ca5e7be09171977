"""Change feeds: debouncing, the latest state of each path, and a streaming updater."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window


def debounce(feed: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """(key, first_ts, last_ts, n): bursts of events of one key; only a gap longer than ``gap_seconds`` ends one.

    In a batch. The gaps and the running number of bursts are per key; a stream takes :func:`debounced_stream`.
    """
    by = Window.partitionBy(key).orderBy(ts)
    micros = F.unix_micros(F.col(ts))
    marked = feed.select(key, ts, F.coalesce((micros - F.lag(micros).over(by) > int(gap_seconds * 1e6)).cast("int"), F.lit(0)).alias("cut"))
    burst = F.sum("cut").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("burst", burst).groupBy(key, "burst").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("burst")


def debounced_stream(feed: DataFrame, gap: str = "300 milliseconds", late: str = "1 second") -> DataFrame:
    """(path, fire_ts, op): on a stream, one row per burst of a path, its last operation, when the burst is over."""
    return feed.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "path").agg(F.max_by("op", "ts").alias("op")).select("path", F.col("w.end").alias("fire_ts"), "op")


def latest_state(feed: DataFrame, key: str, order: list[str], op: str, removed: str) -> DataFrame:
    """The last event of each key, without keys whose last event removes them."""
    rest = [c for c in feed.columns if c not in (key, *order)]
    last = feed.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("x"))
    return last.select(key, "x.*").where(F.col(op) != removed)


def _last_of_each(batch: DataFrame) -> DataFrame:
    return batch.groupBy("path").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "path"]), "ts").alias("x")).select("path", "x.*")


class Updates:
    """A running query over a change feed, which can be ended between two batches."""

    def __init__(self, feed: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, name: str, **trigger):
        self._idle = threading.Lock()

        def once(batch: DataFrame, epoch: int) -> None:
            with self._idle:
                apply(_last_of_each(batch), epoch)

        self.query = feed.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).queryName(name).trigger(**trigger).start()

    def drain(self, timeout: float = 5.0) -> bool:
        """End after the batch in flight; False if that took longer than ``timeout`` seconds and was cut off.

        A batch that was applied, but not yet noted in the checkpoint, comes again after a restart: ``apply`` tells by
        its epoch (as ``StoredGraph.update`` does).
        """
        over = self._idle.acquire(timeout=timeout)
        try:
            self.query.stop()
        finally:
            if over:
                self._idle.release()
        return over


def run_updates(feed: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, name: str = "graph-updates") -> StreamingQuery:
    """Hand what is there of a feed to ``apply``, in micro-batches with their epochs: only each path's last event counts.

    A batch that failed comes again with the same epoch; epochs go on as long as the checkpoint is kept.
    """
    return Updates(feed, apply, checkpoint, name, availableNow=True).query


def follow(feed: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, name: str = "graph-updates", every: str = "1 second") -> Updates:
    """The same, on and on; :meth:`Updates.drain` ends it."""
    return Updates(feed, apply, checkpoint, name, processingTime=every)
