"""Claim and answer states from labelled observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import answer_status, claim_status

STATE = ["support_count", "refute_count", "best_support", "best_refute", "support_ids", "refute_ids", "status"]


def claim_states(claims: DataFrame, decisions: DataFrame, ids: bool = True) -> DataFrame:
    """claim_id, answer_id, required and the state of every claim.

    Different text hashes count once. They are collapsed by a first aggregation per (claim, label, hash), so the second works on
    few rows and no row is expanded for distinct counts. With ``ids`` the observations are listed as well, joined in ascending
    order, '' for none: such a list holds every id of its claim, so plans that need counts, scores or statuses leave it out.
    """
    seen = decisions.filter("label <> 'neutral'").groupBy("claim_id", "label", "text_hash")
    listed = [F.collect_list("observation_id").alias("ids")] if ids else []
    seen = seen.agg(F.max("s").alias("s"), F.max("r").alias("r"), *listed)

    def of(label: str, value: Column) -> Column:
        return F.when(F.col("label") == label, value)

    def joined(label: str) -> Column:
        return F.array_join(F.sort_array(F.flatten(F.collect_list(of(label, F.col("ids"))))), ",").alias(f"{label}_ids")

    states = seen.groupBy("claim_id").agg(
        F.count(of("support", F.lit(1))).alias("support_count"),
        F.count(of("refute", F.lit(1))).alias("refute_count"),
        F.max(of("support", F.col("s"))).alias("best_support"),
        F.max(of("refute", F.col("r"))).alias("best_refute"),
        *([joined("support"), joined("refute")] if ids else []),
    )
    out = claims.select("claim_id", "answer_id", "required").join(states, "claim_id", "left")
    out = out.na.fill(0, ["support_count", "refute_count"]).na.fill("", ["support_ids", "refute_ids"] if ids else [])
    return out.withColumn("status", claim_status("support_count", "refute_count"))


def claim_statuses(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """claim_id, answer_id, required, status: all that deltas and answers need, without the ids."""
    flags = decisions.groupBy("claim_id").agg(F.count_if(F.col("label") == "support").alias("a"), F.count_if(F.col("label") == "refute").alias("b"))
    out = claims.select("claim_id", "answer_id", "required").join(flags, "claim_id", "left").na.fill(0, ["a", "b"])
    return out.select("claim_id", "answer_id", "required", claim_status("a", "b").alias("status"))


def answer_states(states: DataFrame) -> DataFrame:
    """Counts of the required claims of each answer by status, and the answer's status."""
    counts = states.filter("required").groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("required_count"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("supported", "refuted", "conflicted", "unsupported")],
    )
    status = answer_status(*[F.col(f"{x}_count") for x in ("required", "supported", "refuted", "conflicted")])
    return counts.withColumn("status", status)


def least_certificates(decisions: DataFrame) -> DataFrame:
    """The least supporting and refuting observation of each claim that has one."""
    labelled = decisions.filter("label <> 'neutral'")
    return labelled.groupBy("claim_id").agg(
        F.min(F.when(F.col("label") == "support", F.col("observation_id"))).alias("support_id"),
        F.min(F.when(F.col("label") == "refute", F.col("observation_id"))).alias("refute_id"),
    )


def differences(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose rows differ or are on one side only, null-safe, with both rows as structs."""
    a = before.select(key, F.struct(*columns).alias("before"))
    b = after.select(key, F.struct(*columns).alias("after"))
    return a.join(b, key, "full").filter(~F.col("before").eqNullSafe(F.col("after")))


def status_deltas(before: DataFrame, after: DataFrame, key: str, kind: str) -> DataFrame:
    """object_kind, object_id, old_status, new_status of the objects whose status changed."""
    rows = differences(before, after, key, ["status"])
    return rows.select(F.lit(kind).alias("object_kind"), F.col(key).alias("object_id"), F.col("before.status").alias("old_status"), F.col("after.status").alias("new_status"))
