"""Freshness of source trees as a stateful stream: one state and one timer a root, kept by Spark, in place of a polling object.

A stream of events goes in: a file of a root has changed, a run has ended or failed, a root was switched to another tree.
Out come the decisions: a run starts when a root has been still for the debounce time; changes during a run start another
one when it ends; a run that fails gives its changes back; the result of a run from before a switch is discarded. The state
survives a restart with the stream's checkpoint, and events may come late, twice, or out of order within a batch."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import importable

#: Events that go in: `changed` with a path and `switch`, numbered by seq for each root; `done` and `failed` of a run.
EVENT = "root string, seq long, event string, path string, generation long, run long"
#: Decisions that come out: event is stale, run, fresh, failed, discarded or switched; paths are the changes of a run.
DECISION = "root string, event string, generation long, run long, paths array<string>"


@dataclass
class Root:
    """What is known of one root."""

    generation: int = 0
    run: int = 0
    state: str = "fresh"
    pending: list[str] = field(default_factory=list)
    running: list[str] = field(default_factory=list)
    seen: int = -1

    def _wait(self, *paths: str) -> None:
        self.pending += [p for p in dict.fromkeys(paths) if p not in self.pending]

    def _says(self, event: str, *paths: str) -> list[tuple]:
        return [(event, self.generation, self.run, list(paths))]

    def take(self, event: str, seq: int | None = None, path: str | None = None, generation: int | None = None, run: int | None = None) -> list[tuple]:
        """Decisions (event, generation, run, paths) on one event. An event that comes again changes nothing."""
        if event in ("changed", "switch"):
            if seq is not None and seq <= self.seen:
                return []
            self.seen = self.seen if seq is None else seq
        if event == "switch":
            self.generation, self.state, self.pending, self.running = self.generation + 1, "stale", [], []
            return self._says("switched")
        if event == "changed":
            self._wait(path or "")
            if self.state != "fresh":
                return []
            self.state = "stale"
            return self._says("stale")
        if generation != self.generation:
            return [("discarded", generation, run, [])]
        if self.state != "running" or run != self.run:
            return []
        if event == "failed":
            waiting, self.pending = self.pending, []
            self._wait(*self.running, *waiting)
            self.running, self.state = [], "stale"
            return self._says("failed")
        self.running, self.state = [], "stale" if self.pending else "fresh"
        return self._says(self.state)

    @property
    def waits(self) -> bool:
        """Whether a timer has to be set: changes wait and no run is under way."""
        return self.state == "stale" and bool(self.pending)

    def still(self) -> list[tuple]:
        """The decision when the debounce time has passed."""
        if not self.waits:
            return []
        self.running, self.pending, self.state, self.run = self.pending, [], "running", self.run + 1
        return self._says("run", *sorted(self.running))


def decisions(events: DataFrame, debounce_ms: int = 1000) -> DataFrame:
    """Decisions on a stream of events."""
    importable(events.sparkSession)

    def run(key, frames, kept):
        root = Root(**json.loads(kept.get[0])) if kept.exists else Root()
        if kept.hasTimedOut:
            out = root.still()
        else:
            rows = pd.concat(list(frames)).sort_values("seq", na_position="last")
            whole = lambda x: None if pd.isna(x) else int(x)
            out = [d for r in rows.itertuples() for d in root.take(r.event, whole(r.seq), r.path, whole(r.generation), whole(r.run))]
        kept.update((json.dumps(vars(root)),))
        if root.waits:
            kept.setTimeoutDuration(debounce_ms)
        yield pd.DataFrame([(key[0], *d) for d in out], columns=["root", "event", "generation", "run", "paths"])

    asked = events.select("root", "seq", "event", "path", "generation", "run").where("root is not null")
    return asked.groupBy("root").applyInPandasWithState(run, DECISION, "state string", "append", "ProcessingTimeTimeout")


class Refresher:
    """Runs `analyze(root, paths)` as the decisions say. Events lie in a folder, which any process may add to, and the stream
    reads; what a run leads to goes back there as an event."""

    def __init__(self, spark: SparkSession, folder: str, analyze: Callable[[str, list[str]], object], debounce_ms: int = 1000):
        self.spark, self.folder, self.analyze, self.debounce_ms = spark, folder.rstrip("/"), analyze, debounce_ms
        self.log: list[tuple] = []

    def tell(self, *events: tuple) -> None:
        """Adds events, as tuples of EVENT."""
        self.spark.createDataFrame(list(events), EVENT).coalesce(1).write.mode("append").parquet(f"{self.folder}/events")

    def _handle(self, batch: DataFrame, batch_id: int) -> None:
        for row in batch.collect():  # a row for each decision on a root, not for each change
            self.log.append((row["root"], row["event"], row["generation"], row["run"], list(row["paths"] or [])))
            if row["event"] != "run":
                continue
            try:
                self.analyze(row["root"], list(row["paths"]))
                ended = "done"
            except Exception as e:  # the changes go back and wait for the next run
                ended = "failed"
                self.log.append((row["root"], "error", row["generation"], row["run"], [f"{type(e).__name__}: {e}"]))
            self.tell((row["root"], None, ended, None, row["generation"], row["run"]))

    def start(self, every: str = "1 second"):
        """The running query; it may be stopped and started again on the same folder."""
        self.spark.createDataFrame([], EVENT).write.mode("append").parquet(f"{self.folder}/events")
        events = self.spark.readStream.schema(EVENT).parquet(f"{self.folder}/events")
        out = decisions(events, self.debounce_ms).writeStream.foreachBatch(self._handle)
        return out.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(processingTime=every).start()
