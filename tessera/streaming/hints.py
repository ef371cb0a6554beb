"""Change hints: debounced in session windows, coalesced into generations, and turned into index passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.states import CAUSES
from ..plans.index import index_pass
from ..schemas import CHANGE_HINTS

#: Quiet time before a source's hints fire: the debounce and the settling time together.
QUIET_MS = 6_500


def cause_of(kind: Column) -> Column:
    return F.when(kind == "overflow", CAUSES["WatcherOverflow"]).when(kind == "error", CAUSES["WatcherError"]).otherwise(CAUSES["FileHint"])


def hints(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of change hints from JSON files: source_id, ts, kind."""
    return spark.readStream.schema(CHANGE_HINTS).json(folder)


def debounced(changes: DataFrame, quiet_ms: int = QUIET_MS, late: str = "1 minute") -> DataFrame:
    """source_id, first, fires, cause_mask, hints: one row for each run of hints with no pause above ``quiet_ms``.  Batch or stream."""
    c = changes.withColumn("ts", F.col("ts").cast("timestamp"))
    if c.isStreaming:
        c = c.withWatermark("ts", late)
    w = F.session_window("ts", f"{quiet_ms} milliseconds")
    out = c.groupBy("source_id", w.alias("w")).agg(F.bit_or(cause_of(F.col("kind"))).alias("cause_mask"), F.count(F.lit(1)).alias("hints"))
    return out.select("source_id", F.col("w.start").alias("first"), F.col("w.end").alias("fires"), "cause_mask", "hints")


@dataclass(frozen=True)
class Recovery:
    """A source's generations: what was asked for, what runs, what waits, and from when on (seconds)."""

    desired: int = 0
    completed: int = 0
    active: int = 0
    active_mask: int = 0
    pending_mask: int = 0
    attempt: int = 0
    state: str = "Clean"
    due: int = 0


def advanced(r: Recovery, event: str, mask: int, generation: int = 0, most_attempts: int = 5, at: int = 0, base_seconds: int = 0) -> Recovery:
    """The state after one event at a time: request, start, complete, transient (failure) or fail.

    An idle source starts a generation; while one runs, all requests share one successor; a waiting one takes
    further causes in.  A transient failure waits base_seconds, twice as long after every further attempt, and starts before
    that are ignored, unless a manual request has made the source due.  Outcomes of any generation but the active one are ignored.
    """
    if event == "request":
        due = at if mask & CAUSES["Manual"] else r.due
        if r.state in ("Clean", "Degraded") or (r.state == "Running" and r.desired == r.active):
            return replace(r, desired=r.desired + 1, pending_mask=r.pending_mask | mask, state="Running" if r.state == "Running" else "Queued", due=due)
        return replace(r, pending_mask=r.pending_mask | mask, due=due)
    if event == "start":
        ready = r.state == "Queued" and at >= r.due
        return replace(r, active=r.completed + 1, active_mask=r.pending_mask, pending_mask=0, state="Running") if ready else r
    if r.state != "Running" or generation != r.active:
        return r
    if event == "complete":
        return replace(r, completed=r.active, active=0, active_mask=0, attempt=0, state="Queued" if r.desired > r.active else "Clean", due=0)
    again = event == "transient" and r.attempt + 1 < most_attempts
    if again:
        waits = at + base_seconds * 2**r.attempt
        return replace(r, active=0, active_mask=0, attempt=r.attempt + 1, pending_mask=r.pending_mask | r.active_mask | CAUSES["Retry"], state="Queued", due=waits)
    if r.desired > r.active:
        return replace(r, completed=r.active, active=0, active_mask=0, attempt=0, state="Queued", due=0)
    return replace(r, active=0, active_mask=0, attempt=0, state="Degraded", due=0)


_STATE = "desired long, completed long, active long, active_mask int, pending_mask int, attempt int, state string, due long"


def coalesced_stream(events: DataFrame, most_attempts: int = 5, base_seconds: int = 0) -> DataFrame:
    """Ledger rows of a stream of events (source_id, seq, event, mask, generation, and at in seconds, 0 where there is none): the state after each micro-batch."""
    if "at" not in events.columns:
        events = events.withColumn("at", F.lit(0).cast("long"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        r = Recovery(*state.get) if state.exists else Recovery()
        for frame in frames:
            for e in frame.sort_values("seq").itertuples():
                r = advanced(r, e.event, int(e.mask), int(e.generation), most_attempts, int(e.at), base_seconds)
        values = (r.desired, r.completed, r.active, r.active_mask, r.pending_mask, r.attempt, r.state, r.due)
        state.update(values)
        yield pd.DataFrame([(key[0], *values)], columns=["source_id", *(f.split()[0] for f in _STATE.split(", "))])

    return events.groupBy("source_id").applyInPandasWithState(step, f"source_id string, {_STATE}", _STATE, "update", GroupStateTimeout.NoTimeout)


def indexing(spark: SparkSession, snapshot_of: Callable[[DataFrame], DataFrame], base: str, **how) -> Callable[[DataFrame, int], None]:
    """A pass for ``index_changes``: what ``snapshot_of`` lists of the due sources goes through ``index_pass``; other sources stay as they are."""

    def run(due: DataFrame, batch_id: int) -> None:
        index_pass(spark, snapshot_of(due), base, sources=due, **how)

    return run


def index_changes(changes: DataFrame, run_pass: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """For every micro-batch of debounced changes, call run_pass(sources that are due, batch id); passes may be repeated safely."""

    def each(batch: DataFrame, batch_id: int) -> None:
        due = batch.select("source_id").distinct()
        if not due.isEmpty():
            run_pass(due, batch_id)

    return debounced(changes).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
