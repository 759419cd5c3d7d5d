"""Rate limits request by request: a window starts with an identity's first request after the last one has ended, and a
request is refused while too many are in flight or once the window has had its number.

What a request meets depends on what the requests before it met, so an identity's requests are folded in order. In batch
they are sorted by Spark and streamed through one state at a time, so memory doesn't grow with a hot identity; on a stream
the same fold runs on state that Spark keeps."""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import importable

#: Columns of the verdicts, beside the identity.
VERDICT = "id long, at long, ok boolean, reason string"


@dataclass
class Limits:
    """An identity's state. Times are in microseconds."""

    per_window: int
    window: int
    in_flight: int
    started: int | None = None
    requests: int = 0
    ends: list = field(default_factory=list)

    def ask(self, at: int, takes: int) -> str | None:
        """The reason of a refusal, else None. A request that ends at a moment is no longer in flight then."""
        while self.ends and self.ends[0] <= at:
            heapq.heappop(self.ends)
        if self.started is None or at - self.started >= self.window:
            self.started, self.requests = at, 0
        if len(self.ends) >= self.in_flight:
            return "concurrency"
        if self.requests >= self.per_window:
            return "rate"
        self.requests += 1
        heapq.heappush(self.ends, at + takes)
        return None


def verdicts(requests: DataFrame, per_window: int, window: int, in_flight: int) -> DataFrame:
    """(identity, id, at, ok, reason) of requests (identity, id, at, takes: microseconds), in the order of at, then id.

    Requests of no identity share one. Negative or missing durations take no time; requests without a time are refused."""
    importable(requests.sparkSession)
    kind = dict(requests.dtypes)["identity"]

    def run(batches):
        state, who, known = None, None, False
        for pdf in batches:
            rows = []
            for identity, id_, at, takes in zip(pdf["identity"], pdf["id"], pdf["at"], pdf["takes"]):
                identity = None if pd.isna(identity) else identity
                if not known or identity != who:
                    state, who, known = Limits(per_window, window, in_flight), identity, True
                reason = "time" if pd.isna(at) else state.ask(int(at), max(int(takes), 0))
                rows.append((identity, id_, at, reason is None, reason))
            yield pd.DataFrame(rows, columns=["identity", "id", "at", "ok", "reason"], dtype=object)

    asked = requests.select("identity", F.col("id").cast("long"), F.col("at").cast("long"), F.coalesce(F.col("takes").cast("long"), F.lit(0)).alias("takes"))
    dealt = asked.repartition("identity").sortWithinPartitions("identity", F.col("at").asc_nulls_last(), "id")
    return dealt.mapInPandas(run, f"identity {kind}, {VERDICT}")


def stream_verdicts(requests: DataFrame, per_window: int, window: int, in_flight: int, idle_ms: int = 3_600_000) -> DataFrame:
    """As `verdicts` on a stream: requests of a micro-batch go in the order of their times, on the state that the batches
    before have left. An identity's state goes once it has been idle for `idle_ms`."""
    importable(requests.sparkSession)
    kind = dict(requests.dtypes)["identity"]

    def run(key, frames, kept):
        if kept.hasTimedOut:
            kept.remove()
            return
        state = Limits(per_window, window, in_flight)
        if kept.exists:
            state.started, state.requests, state.ends = json.loads(kept.get[0])
        asked = pd.concat(list(frames)).sort_values(["at", "id"])
        rows = []
        for id_, at, takes in zip(asked["id"], asked["at"], asked["takes"]):
            reason = state.ask(int(at), max(int(takes), 0))
            rows.append((key[0], id_, at, reason is None, reason))
        kept.update((json.dumps([state.started, state.requests, state.ends]),))
        kept.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["identity", "id", "at", "ok", "reason"])

    asked = requests.where("at is not null").select("identity", F.col("id").cast("long"), F.col("at").cast("long"), F.coalesce(F.col("takes").cast("long"), F.lit(0)).alias("takes"))
    return asked.groupBy("identity").applyInPandasWithState(run, f"identity {kind}, {VERDICT}", "state string", "append", "ProcessingTimeTimeout")


def busiest(requests: DataFrame) -> DataFrame:
    """(identity, at, in_flight): the first moment at which most requests (identity, at, takes) of an identity are in flight.

    A sweep over starts and ends: what has ended at a moment goes before what starts then."""
    from pyspark.sql import Window

    starts = requests.where("takes > 0").select("identity", F.col("at").cast("long").alias("at"), F.lit(1).alias("step"))
    ends = requests.where("takes > 0").select("identity", (F.col("at") + F.col("takes")).cast("long").alias("at"), F.lit(-1).alias("step"))
    moves = starts.unionByName(ends).groupBy("identity", "at").agg(F.sum("step").alias("step"))
    order = Window.partitionBy("identity").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    running = moves.withColumn("in_flight", F.sum("step").over(order))
    return running.groupBy("identity").agg(F.max(F.struct("in_flight", (-F.col("at")).alias("before"))).alias("m")).select("identity", (-F.col("m.before")).alias("at"), F.col("m.in_flight").alias("in_flight"))
