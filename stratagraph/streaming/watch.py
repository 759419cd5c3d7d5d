"""Live refresh of a source tree, and windows over its events.

Spark's file source sees new files only, so edits and deletes are found by comparing listings with digests; Structured
Streaming drives the polls: a rate stream's batches are serial, and a batch that fails is run again."""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import collect_files

#: Extensions whose changes start a run.
WATCHED = (".ts", ".tsx", ".js", ".jsx", ".prisma", ".kt")


@dataclass
class Freshness:
    """fresh, analyzing or stale, with the time of the last run and the changes waiting."""

    state: str = "stale"
    last_analyzed_ms: int | None = None
    pending: int = 0


def listing(root: str) -> dict[str, str]:
    """Digest of each watched file."""
    out = {}
    for p in collect_files(root):
        if p.endswith(WATCHED):
            try:
                out[p] = hashlib.sha256((Path(root) / p).read_bytes()).hexdigest()
            except OSError:
                continue
    return out


def difference(before: dict[str, str], after: dict[str, str]) -> dict[str, str]:
    """path -> added, changed or deleted."""
    out = {p: "added" for p in after.keys() - before.keys()}
    out |= {p: "deleted" for p in before.keys() - after.keys()}
    return out | {p: "changed" for p in after.keys() & before.keys() if after[p] != before[p]}


@dataclass
class Watcher:
    """Runs `analyze(root)` when a tree has changed and been still for the debounce time.

    Runs are serial. Changes during a run start another one; a run that fails gives its changes back; a run whose root was
    replaced meanwhile is discarded, by its generation. Events: stale, analyzing, fresh, failed, discarded, switched."""

    root: str
    analyze: Callable[[str], object]
    publish: Callable[[object], None] = lambda result: None
    debounce_s: float = 1.0
    events: list[tuple[str, object]] = field(default_factory=list)
    listeners: list[Callable[[str, object], None]] = field(default_factory=list)
    freshness: Freshness = field(default_factory=Freshness)

    def __post_init__(self):
        self._lock, self._generation, self._known, self._seen, self._since = threading.RLock(), 0, {}, {}, None

    def _emit(self, name: str, value: object = None) -> None:
        self.events.append((name, value))
        for f in list(self.listeners):
            f(name, value)

    def switch(self, root: str) -> None:
        """Watch another tree; what runs for the old one will be discarded."""
        with self._lock:
            self.root, self._known, self._seen, self._since = root, {}, {}, None
            self._generation += 1
            self.freshness = Freshness()
            self._emit("switched", root)

    def poll(self, now: float | None = None) -> bool:
        """One look at the tree; True if a run was made and published."""
        now = time.monotonic() if now is None else now
        with self._lock:
            generation, root = self._generation, self.root
            current = listing(root)
            if current != self._seen:
                self._seen, self._since = current, now
            changes = difference(self._known, current)
            self.freshness.pending = len(changes)
            if not changes:
                return False
            if self.freshness.state != "stale":
                self.freshness.state = "stale"
                self._emit("stale", changes)
            if self._since is None or now - self._since < self.debounce_s:
                return False
            before, self._known = self._known, current
            self.freshness.state = "analyzing"
            self._emit("analyzing", changes)
        try:
            result = self.analyze(root)
        except Exception as e:
            with self._lock:
                if generation == self._generation:
                    self._known = before
                    self.freshness.state = "stale"
                self._emit("failed", f"{type(e).__name__}: {e}")
            return False
        with self._lock:
            if generation != self._generation:
                self._emit("discarded", root)
                return False
            self.publish(result)
            self.freshness = Freshness("fresh", int(time.time() * 1000), 0)
            self._emit("fresh", result)
            return True

    def stream(self, spark: SparkSession, every: str = "1 second"):
        """A streaming query that polls at each trigger; stop() ends it."""
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(lambda batch, batch_id: self.poll() and None).trigger(processingTime=every).start()


def refresh_stream(files: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch of a stream of files (path, text, ord) to `handle`; serial, and replayed after a failure."""
    return files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()


def event_counts(events: DataFrame, size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window. ts may be a timestamp without zone; it is read as UTC. On a stream, the state of
    a window goes once the watermark has passed it."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def request_limits(events: DataFrame, most: int, size: str = "1 minute") -> DataFrame:
    """user_id, start, n, allowed of a fixed-window rate limit."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    counts = timed.groupBy("user_id", F.window("at", size)).agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("window.start").alias("start"), "n", (F.col("n") <= most).alias("allowed"))
