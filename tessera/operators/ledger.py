"""Run ledger: due work, retention, transitions, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.states import CAUSES, backoff_seconds, bounded_outcome, cause_names, is_transient, presentation, safe_error
from ..functions.text import root_hash

OPEN, TERMINAL = ["Pending", "Processing", "RetryScheduled"], ["Completed", "Failed", "Cancelled", "Superseded"]


def live_runs(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Runs of sources that are Active and not Paused."""
    live = sources.filter((F.col("lifecycle_state") == "Active") & (F.col("status") != "Paused")).select("source_id")
    return runs.join(live, "source_id", "left_semi")


def due_runs(runs: DataFrame, now: Column) -> DataFrame:
    """Open runs that are due and have no earlier open generation in their source."""
    first = F.min("generation").over(Window.partitionBy("source_id"))
    open_ = runs.filter(F.col("status").isin(OPEN)).withColumn("_first", first).filter(F.col("generation") == F.col("_first")).drop("_first")
    ready = (F.col("status") == "Pending") & (F.col("next_attempt").isNull() | (F.col("next_attempt") <= now))
    retry = (F.col("status") == "RetryScheduled") & (F.coalesce("next_attempt", now) <= now)
    expired = (F.col("status") == "Processing") & (F.col("lease_expires") <= now)
    return open_.filter(ready | retry | expired)


def next_due(runs: DataFrame, now: Column) -> DataFrame:
    """source_id, next_due: when each source's first open run falls due."""
    first = F.min("generation").over(Window.partitionBy("source_id"))
    open_ = runs.filter(F.col("status").isin(OPEN)).withColumn("_first", first).filter(F.col("generation") == F.col("_first"))
    at = F.when(F.col("status") == "Processing", F.col("lease_expires")).otherwise(F.coalesce("next_attempt", now))
    return open_.groupBy("source_id").agg(F.min(at).alias("next_due"))


def first_unfinished(runs: DataFrame) -> DataFrame:
    order = Window.partitionBy("source_id", "status").orderBy("generation", "job_id")
    return runs.filter(F.col("status").isin(OPEN)).withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def coalesced(requests: DataFrame) -> DataFrame:
    """One request a source: all causes, the latest target that is given, force if any.  requests: source_id, ts, cause_mask, target, force."""
    latest = F.max_by("target", F.when(F.col("target").isNotNull(), F.struct("ts", "target")))
    return requests.groupBy("source_id").agg(F.bit_or("cause_mask").alias("cause_mask"), latest.alias("target"), F.bool_or("force").alias("force"), F.count(F.lit(1)).alias("requests"))


def after_failure(failures: DataFrame, most_attempts: int, base_seconds: int) -> DataFrame:
    """The next state of failed runs.  failures: job_id, attempt, code, cause_mask."""
    again = is_transient(F.col("code")) & (F.col("attempt") + 1 < most_attempts)
    return failures.select(
        "job_id", F.when(again, "RetryScheduled").otherwise("Failed").alias("status"), F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"),
        F.when(again, F.col("cause_mask").bitwiseOR(F.lit(CAUSES["Retry"]))).otherwise(F.col("cause_mask")).alias("cause_mask"),
        F.when(again, backoff_seconds(F.lit(base_seconds), F.col("attempt"))).otherwise(0).alias("delay_s"), (~again).alias("dead_letter"),
    )


def recovered(runs: DataFrame, now: Column) -> DataFrame:
    """Processing runs past their lease are scheduled again."""
    late = (F.col("status") == "Processing") & (F.col("lease_expires") <= now)
    return runs.withColumns({"status": F.when(late, "RetryScheduled").otherwise(F.col("status")), "cause_mask": F.when(late, F.col("cause_mask").bitwiseOR(F.lit(CAUSES["Retry"]))).otherwise(F.col("cause_mask")), "recovered": late})


def current_outcomes(outcomes: DataFrame, runs: DataFrame) -> DataFrame:
    """Outcomes that carry their run's lease and epoch; others came too late."""
    return outcomes.join(runs.select("job_id", "lease_id", "lifecycle_epoch"), ["job_id", "lease_id", "lifecycle_epoch"], "left_semi")


def prunable(runs: DataFrame, keep: int) -> DataFrame:
    """job_id of runs that retention drops: beyond the newest ``keep`` terminal runs of a source; a failure only once a later generation completed."""
    order = Window.partitionBy("source_id").orderBy(F.desc("completed"), F.desc("generation"), F.desc("job_id"))
    done = F.max(F.when(F.col("status") == "Completed", F.col("generation"))).over(Window.partitionBy("source_id"))
    terminal = runs.filter(F.col("status").isin(TERMINAL)).withColumn("_done", done)
    ranked = terminal.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") > keep)
    return ranked.filter((F.col("status") != "Failed") | (F.col("_done") > F.col("generation"))).select("job_id")


def kept_letters(letters: DataFrame, runs: DataFrame, keep: int) -> DataFrame:
    """Dead letters whose run is still there and hasn't completed since."""
    alive = runs.join(prunable(runs, keep), "job_id", "left_anti").filter(F.col("status") != "Completed")
    return letters.join(alive.select("job_id"), "job_id", "left_semi")


def by_cause(requests: DataFrame) -> DataFrame:
    """cause, requests: one count for each bit that is set; unknown bits and no bits count as Other."""
    known = sum(CAUSES.values())
    names = F.concat(cause_names(F.col("cause_mask")), F.when((F.col("cause_mask").bitwiseAND(F.lit(~known)) != 0) | (F.col("cause_mask") == 0), F.array(F.lit("Other"))).otherwise(F.array().cast("array<string>")))
    return requests.select(F.explode(names).alias("cause")).groupBy("cause").agg(F.count(F.lit(1)).alias("requests"))


def by_outcome(runs: DataFrame) -> DataFrame:
    return runs.groupBy(bounded_outcome(F.col("outcome")).alias("outcome")).agg(F.count(F.lit(1)).alias("runs"))


def durations(runs: DataFrame) -> DataFrame:
    """Total and last duration, negatives as 0.  runs: job_id, finished, ms."""
    ms = F.greatest(F.lit(0), F.col("ms"))
    return runs.agg(F.sum(ms).alias("total_ms"), F.max_by(ms, F.struct("finished", "job_id")).alias("last_ms"))


def gauges(recovery: DataFrame) -> DataFrame:
    return recovery.agg(F.count_if(F.col("desired_generation") > F.col("completed_generation")).alias("dirty"), F.count_if(F.col("state") == "Degraded").alias("degraded"))


def snapshot(runs: DataFrame, requests: DataFrame, recovery: DataFrame) -> DataFrame:
    """One row: the operational figures together; runs by outcome and requests by cause as sorted lists."""
    outcomes = by_outcome(runs).agg(F.array_sort(F.collect_list(F.concat_ws(":", "outcome", F.col("runs").cast("string")))).alias("outcomes"), F.lit(1).alias("_k"))
    causes = by_cause(requests).agg(F.array_sort(F.collect_list(F.concat_ws(":", "cause", F.col("requests").cast("string")))).alias("causes"), F.lit(1).alias("_k"))
    one = gauges(recovery).withColumn("_k", F.lit(1)).join(durations(runs).withColumn("_k", F.lit(1)), "_k").join(outcomes, "_k").join(causes, "_k")
    return one.select("dirty", "degraded", "total_ms", "last_ms", F.array_join("outcomes", ",").alias("outcomes"), F.array_join("causes", ",").alias("causes"))


def pending_mask(runs: DataFrame, sources: DataFrame) -> DataFrame:
    waiting = runs.filter(F.col("status").isin("Pending", "RetryScheduled")).groupBy("source_id").agg(F.max("cause_mask").alias("m"))
    return sources.select("source_id").join(waiting, "source_id", "left").select("source_id", F.coalesce("m", F.lit(0)).alias("pending_mask"))


def checkpoints(runs: DataFrame) -> DataFrame:
    done = runs.filter(F.col("status") == "Completed")
    return done.groupBy("source_id").agg(F.max_by("job_id", F.struct("completed", "job_id")).alias("job_id"), F.max("completed").alias("completed"))


def fleet(sources: DataFrame, recovery: DataFrame) -> DataFrame:
    both = sources.join(recovery.select("source_id", F.col("state").alias("rs")), "source_id", "left")
    degraded = (F.col("status") == "Degraded") | (F.coalesce("rs", F.lit("")) == "Degraded")
    recovering = ~degraded & F.coalesce(F.col("rs").isin("Queued", "Running"), F.lit(False))
    return both.agg(F.count_if(degraded).alias("degraded"), F.count_if(recovering).alias("recovering"), F.count(F.lit(1)).alias("registered"))


# state tables: events in, the next version out


def profiles_ensured(sources: DataFrame, profiles: DataFrame, chunks: DataFrame, configured: str) -> DataFrame:
    """source_id, active_fingerprint for every source: what it has, legacy-generic-1 if it has chunks but no profile, else the configured one."""
    has = chunks.select("source_id").distinct().withColumn("_has", F.lit(True))
    out = sources.select("source_id").join(profiles.select("source_id", "active_fingerprint"), "source_id", "left").join(has, "source_id", "left")
    return out.select("source_id", F.coalesce("active_fingerprint", F.when(F.col("_has"), "legacy-generic-1").otherwise(configured)).alias("active_fingerprint"))


def profile_changes(profiles: DataFrame, events: DataFrame) -> DataFrame:
    """profiles after one event each (begin, complete, fail); ``refused`` marks guards that didn't hold.

    events: source_id, event, fingerprint.
    """
    p = profiles.join(events, "source_id", "left")
    begin = (F.col("event") == "begin") & (F.col("state") != "Reindexing")
    ending = F.col("event").isin("complete", "fail") & (F.col("state") == "Reindexing") & (F.col("pending_fingerprint") == F.col("fingerprint"))
    done, failed = ending & (F.col("event") == "complete"), ending & (F.col("event") == "fail")
    active = F.when(done, F.col("fingerprint")).otherwise(F.col("active_fingerprint"))
    pending = F.when(begin, F.col("fingerprint")).when(~F.coalesce(done, F.lit(False)), F.col("pending_fingerprint"))
    state = F.when(begin, "Reindexing").when(done, "Ready").when(failed, "Failed").otherwise(F.col("state"))
    return p.select("source_id", active.alias("active_fingerprint"), pending.alias("pending_fingerprint"), state.alias("state"), (F.col("event").isNotNull() & ~F.coalesce(begin | ending, F.lit(False))).alias("refused"))


def reindex_needed(profiles: DataFrame, configured: str) -> DataFrame:
    need = (F.col("active_fingerprint") != configured) | (F.col("state") != "Ready") | F.col("pending_fingerprint").isNotNull()
    return profiles.select("source_id", need.alias("reindex_needed"))


def with_status(sources: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """sources after status changes (source_id, to_status, to_error) of Active ones; scan and success times follow the status.

    sources: source_id, status, lifecycle_state, last_error, last_scan, last_success, updated.
    """
    both = sources.join(changes, "source_id", "left")
    hit = F.col("to_status").isNotNull() & (F.col("lifecycle_state") == "Active")
    scanned = hit & F.col("to_status").isin("Indexing", "Ready", "Degraded")
    new = {"status": (hit, F.col("to_status")), "last_error": (hit, F.col("to_error")), "last_scan": (scanned, now), "last_success": (hit & (F.col("to_status") == "Ready"), now), "updated": (hit, now)}
    return both.withColumns({c: F.when(test, value).otherwise(F.col(c)) for c, (test, value) in new.items()}).drop("to_status", "to_error")


def queued_sources(sources: DataFrame, queued: DataFrame, now: Column) -> DataFrame:
    """sources when runs are requested for ``queued`` (source_id): Active and not Paused ones are Indexing from now on, but a Degraded one stays so."""
    mark = queued.select("source_id").distinct().withColumn("_queued", F.lit(True))
    hit = F.coalesce("_queued", F.lit(False)) & (F.col("lifecycle_state") == "Active") & (F.col("status") != "Paused")
    both = sources.join(mark, "source_id", "left")
    return both.withColumns({"status": F.when(hit & (F.col("status") != "Degraded"), "Indexing").otherwise(F.col("status")), "updated": F.when(hit, now).otherwise(F.col("updated"))}).drop("_queued")


def completed_recovery(recovery: DataFrame, completions: DataFrame) -> DataFrame:
    """Recovery rows after completed runs.  completions: source_id, generation, changed, deleted, unchanged."""
    c = F.greatest("completed_generation", "generation")
    both = recovery.join(completions, "source_id", "left").withColumn("done", F.coalesce(c, F.col("completed_generation")))
    state = F.when(F.col("generation").isNull(), F.col("state")).when(F.col("done") >= F.col("desired_generation"), "Clean").otherwise("Queued")
    return both.select("source_id", "desired_generation", F.col("done").alias("completed_generation"), state.alias("state"), *(F.greatest(F.lit(0), F.coalesce(n, F.lit(0))).alias(f"last_{n}_files") for n in ("changed", "deleted", "unchanged")))


def completed_sources(sources: DataFrame, recovery: DataFrame, completions: DataFrame, now: Column) -> DataFrame:
    """sources after completed runs of their own epoch: Ready, or Indexing where a later generation waits; Paused ones stay as they are.

    recovery: as ``completed_recovery`` returns it.  completions: source_id, lifecycle_epoch.
    """
    done = completions.join(recovery.select("source_id", "state"), "source_id").join(sources.select("source_id", "lifecycle_epoch", F.col("status").alias("_now")), ["source_id", "lifecycle_epoch"]).filter(F.col("_now") != "Paused")
    to = done.select("source_id", F.when(F.col("state") == "Queued", "Indexing").otherwise("Ready").alias("to_status"), F.lit(None).cast("string").alias("to_error"))
    return with_status(sources, to, now)


def source_list(sources: DataFrame, recovery: DataFrame) -> DataFrame:
    """Sources by name with what may be shown of them: source_id, display_name, root_hash, status, label, detail, action, error, last_success."""
    both = sources.join(recovery, "source_id", "left")
    shown = presentation(F.col("state"), F.col("status"), F.col("completed_generation"), F.col("desired_generation"), F.col("code"))
    error = safe_error(F.col("last_error"), F.col("code"))
    out = both.select("source_id", "display_name", root_hash(F.col("root")).alias("root_hash"), "status", shown.alias("x"), error.alias("error"), "last_success")
    return out.select("source_id", "display_name", "root_hash", "status", "x.label", "x.detail", "x.action", "error", "last_success").orderBy("display_name", "source_id")


def source_status(sources: DataFrame, recovery: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``source_list`` that ``asked`` (source_id) names; unknown sources give no row."""
    return source_list(sources.join(asked.select("source_id").distinct(), "source_id", "left_semi"), recovery)


def tombstoned(sources: DataFrame, runs: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, runs) after removals: epoch one up, Removing, waiting runs Cancelled."""
    gone = removed.select("source_id").distinct().withColumn("_gone", F.lit(True))
    hit = F.coalesce("_gone", F.lit(False))
    s = sources.join(gone, "source_id", "left").withColumns({"lifecycle_epoch": F.col("lifecycle_epoch") + hit.cast("int"), "lifecycle_state": F.when(hit, "Removing").otherwise(F.col("lifecycle_state"))}).drop("_gone")
    r = runs.join(gone, "source_id", "left").withColumn("status", F.when(hit & F.col("status").isin("Pending", "RetryScheduled"), "Cancelled").otherwise(F.col("status"))).drop("_gone")
    return s, r


def recovery_violations(recovery: DataFrame) -> DataFrame:
    """source_id, rule of recovery rows that can't be."""
    rules = {"completed beyond desired": F.col("completed_generation") > F.col("desired_generation"), "clean but behind": (F.col("state") == "Clean") & (F.col("completed_generation") < F.col("desired_generation")), "running without generation": (F.col("state") == "Running") & F.col("active_generation").isNull(), "negative generation": F.least("desired_generation", "completed_generation") < 0}
    broken = F.array_compact(F.array(*(F.when(test, name) for name, test in rules.items())))
    return recovery.select("source_id", F.explode(broken).alias("rule"))


def migrated(legacy: DataFrame) -> DataFrame:
    """job_id, status, generation of open runs from before generations: the first stays, the next carries the rest's merged request, the others are superseded."""
    order = Window.partitionBy("source_id").orderBy("requested", "job_id")
    rest = Window.partitionBy("source_id", F.col("r") > 1)
    r = legacy.filter(F.col("status").isin(OPEN)).withColumn("r", F.row_number().over(order))
    mask = F.when(F.col("r") == 1, F.col("cause_mask")).when(F.col("r") == 2, F.bit_or("cause_mask").over(rest)).otherwise(F.col("cause_mask"))
    force = F.when(F.col("r") == 2, F.bool_or("force").over(rest)).otherwise(F.col("force"))
    return r.select("source_id", "job_id", F.when(F.col("r") <= 2, F.col("status")).otherwise("Superseded").alias("status"), F.least("r", F.lit(2)).cast("long").alias("generation"), mask.alias("cause_mask"), force.alias("force"))


def triage(sources: DataFrame, recovery: DataFrame, now: Column, stale_after_s: int) -> DataFrame:
    """source_id, verdict, priority: ready, processing, failed, stale or unknown, from the fields alone; what blocks comes first."""
    both = sources.join(recovery.select("source_id", F.col("state").alias("rs")), "source_id", "left")
    verdict = F.when(F.col("status").isin("Degraded", "Failed") | (F.col("rs") == "Degraded"), "failed").when(F.col("status").isin("Pending", "Indexing") | F.col("rs").isin("Queued", "Running"), "processing").when(F.col("last_success").isNull(), "unknown").when(now - F.col("last_success") > stale_after_s, "stale").otherwise("ready")
    return both.select("source_id", verdict.alias("verdict")).withColumn("priority", F.array_position(F.array(*map(F.lit, ["failed", "stale", "unknown", "processing", "ready"])), F.col("verdict")).cast("int"))
