"""The event log: idempotent replay, states of epochs and jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def payload_digest(fields: Sequence[str]) -> Column:
    return F.sha2(F.concat_ws("\u0000", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256)


def replays(events: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    """key, deliveries, variants and state: once, replayed (same payload again) or conflict (different payloads)."""
    rows = events.select(key, payload_digest(payload).alias("h")).groupBy(key, "h").agg(F.count(F.lit(1)).alias("n"))
    out = rows.groupBy(key).agg(F.sum("n").alias("deliveries"), F.count(F.lit(1)).alias("variants"))
    state = F.when(F.col("variants") > 1, "conflict").when(F.col("deliveries") > 1, "replayed").otherwise("once")
    return out.withColumn("state", state)


def new_events(events: DataFrame, applied: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """(events not applied yet, conflicts): an event with a known key and digest is a replay and drops out, one with a known key
    and another digest is a conflict."""
    fresh = events.dropDuplicates([key, digest]).join(applied.select(key), key, "left_anti")
    known = applied.select(key, F.col(digest).alias("__known"))
    clash = events.join(known, key).filter(F.col(digest) != F.col("__known")).drop("__known")
    return fresh, clash


def evaluation_state(failed: Column, open_scope: Column, target_failed: Column, open_job: Column) -> Column:
    """Failed epochs first, then open scopes, failed targets and open jobs; complete if nothing is open."""
    return F.when(failed, "failed").when(open_scope, "pending").when(target_failed, "failed").when(open_job, "pending").otherwise("complete")


def attempt_reason(epoch_active: Column, requirement_active: Column, group_active: Column, chunk_active: Column, terminal: Column) -> Column:
    """Why a late attempt has no effect, by precedence; null if it counts."""
    inactive = (F.coalesce(requirement_active, F.lit(True)) & F.coalesce(group_active, F.lit(True))) == F.lit(False)
    return F.when(~epoch_active, "epoch_failed").when(inactive, "subject_inactive").when(~chunk_active, "chunk_inactive").when(terminal, "job_already_terminal")


#: The transitions a job may make.
TRANSITIONS = {
    "pending": ("leased", "cancelled"),
    "leased": ("completed", "retryable", "failed", "cancelled", "completed_inactive"),
    "retryable": ("leased", "failed", "cancelled"),
}


def bad_transitions(changes: DataFrame, before: str, after: str) -> DataFrame:
    """State changes that no rule allows."""
    allowed = [f"{a}>{b}" for a, many in TRANSITIONS.items() for b in many]
    return changes.filter(~F.concat_ws(">", before, after).isin(allowed))


def bijection_gaps(children: DataFrame, admitted: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that only one of both sides has, or that one side has more than once: empty behind a root barrier."""
    a, b = (df.groupBy(*key).agg(F.count(F.lit(1)).alias(n)) for df, n in ((children, "jobs"), (admitted, "pairs")))
    return a.join(b, list(key), "full").na.fill(0, ["jobs", "pairs"]).filter("jobs <> 1 or pairs <> 1")
