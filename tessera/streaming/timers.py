"""Generations of sources as a stream with timers: a retry that waits starts when its time has come, and a run that is past its lease is scheduled again, without any further event.

The state of a source is a ``Recovery`` and the time its lease ends, in a value state; timers run on processing time.  Sources that
have been clean for ``forget_seconds`` are dropped from the state.  Needs the RocksDB state store (``with_timers`` sets it).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions.states import CAUSES
from .hints import Recovery, advanced

STATE = "desired long, completed long, active long, active_mask int, pending_mask int, attempt int, state string, due long"
_KINDS = {"long": LongType(), "int": IntegerType(), "string": StringType()}
#: As types, since the processor's own process has no session to read a schema text with.
_STORED = StructType([StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in f"{STATE}, lease_ends long".split(", "))])
#: What made a row: an event of the stream, a retry whose time has come, or a lease that ran out.
ROW = f"source_id string, {STATE}, lease_ends long, why string, at_ms long"


def with_timers(spark: SparkSession) -> SparkSession:
    """The session with the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def expired(r: Recovery, lease_ends: int, now: int) -> bool:
    """Whether the active run is past its lease at ``now`` (seconds)."""
    return r.state == "Running" and 0 < lease_ends <= now


class Generations(StatefulProcessor):
    """One source's generations; see ``timed_generations``."""

    def __init__(self, most_attempts: int, base_seconds: int, lease_seconds: int, forget_seconds: int):
        self.most_attempts, self.base_seconds, self.lease_seconds, self.forget_seconds = most_attempts, base_seconds, lease_seconds, forget_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("recovery", _STORED)

    def _held(self) -> tuple[Recovery, int]:
        if not self.value.exists():
            return Recovery(), 0
        *fields, lease_ends = self.value.get()
        return Recovery(*fields), lease_ends

    def _kept(self, key: tuple, r: Recovery, lease_ends: int, now_ms: int, why: str) -> pd.DataFrame:
        """Write the state, set the one timer that it waits for, and the row to send."""
        self.value.update((*astuple(r), lease_ends))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        now = now_ms // 1000
        if r.state == "Running" and lease_ends:
            self.handle.registerTimer(max(lease_ends * 1000, now_ms + 1))
        elif r.state == "Queued" and r.due > now:
            self.handle.registerTimer(r.due * 1000)
        elif r.state == "Clean":
            self.handle.registerTimer(now_ms + 1000 * self.forget_seconds)
        return pd.DataFrame([(key[0], *astuple(r), lease_ends, why, now_ms)], columns=[f.split()[0] for f in ROW.split(", ")])

    def _next(self, r: Recovery, lease_ends: int, event: str, mask: int, generation: int, now: int) -> tuple[Recovery, int]:
        after = advanced(r, event, mask, generation, self.most_attempts, now, self.base_seconds)
        if after.state != "Running":
            return after, 0
        return after, now + self.lease_seconds if r.state != "Running" else lease_ends

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now_ms = timerValues.getCurrentProcessingTimeInMs()
        r, lease_ends = self._held()
        for e in pd.concat(list(rows)).sort_values("seq").itertuples():
            r, lease_ends = self._next(r, lease_ends, e.event, int(e.mask), int(e.generation), now_ms // 1000)
        yield self._kept(key, r, lease_ends, now_ms, "events")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now_ms = timerValues.getCurrentProcessingTimeInMs()
        now = now_ms // 1000
        r, lease_ends = self._held()
        if expired(r, lease_ends, now):
            r, lease_ends = self._next(r, lease_ends, "transient", CAUSES["Retry"], r.active, now)
            yield self._kept(key, r, lease_ends, now_ms, "lease")
        elif r.state == "Queued" and now >= r.due:
            r, lease_ends = self._next(r, lease_ends, "start", 0, 0, now)
            yield self._kept(key, r, lease_ends, now_ms, "retry")
        elif r.state == "Clean":
            self.value.clear()


def timed_generations(events: DataFrame, most_attempts: int = 5, base_seconds: int = 30, lease_seconds: int = 900, forget_seconds: int = 86_400) -> DataFrame:
    """Rows of ROW: the state of every source after the events (source_id, seq, event, mask, generation) of a micro-batch, and after each timer.

    A run that fails transiently waits base_seconds, twice as long after every further attempt, and is then started by its timer; one that sends no
    outcome for lease_seconds counts as failed transiently.
    """
    processor = Generations(most_attempts, base_seconds, lease_seconds, forget_seconds)
    return events.select("source_id", "seq", "event", "mask", "generation").groupBy("source_id").transformWithStateInPandas(processor, ROW, "Update", "ProcessingTime")


def fired(runs: DataFrame, now) -> DataFrame:
    """job_id, why, fired_at: the timers of ``runs`` (job_id, status, next_attempt, lease_expires) that have fired by ``now``, in batch form."""
    retry = (F.col("status") == "RetryScheduled") & (F.col("next_attempt") <= now)
    lease = (F.col("status") == "Processing") & (F.col("lease_expires") <= now)
    why = F.when(retry, "retry").when(lease, "lease")
    return runs.select("job_id", why.alias("why"), F.when(retry, F.col("next_attempt")).otherwise(F.col("lease_expires")).alias("fired_at")).filter(F.col("why").isNotNull())
