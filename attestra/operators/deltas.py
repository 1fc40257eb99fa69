"""Signed deltas: what a policy change or a withdrawal adds to and takes from the counted evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policy import claim_status, decide, potential_partition

Policy = tuple[float, float]


def _flips(rows: DataFrame, old: Policy, new: Policy) -> DataFrame:
    rows = rows.withColumn("old_label", decide("s", "r", "n", *old)).withColumn("new_label", decide("s", "r", "n", *new))
    return rows.filter("old_label <> new_label")


def flips_by_range(rows: DataFrame, old: Policy, new: Policy) -> DataFrame:
    """Observations whose label differs: candidates have a score between the thresholds, a filter that reaches sorted files."""
    candidate = F.lit(False)
    for score, a, b in (("s", old[0], new[0]), ("r", old[1], new[1])):
        if a != b:
            candidate = candidate | ((F.col(score) >= min(a, b)) & (F.col(score) < max(a, b)))
    return _flips(rows.filter(candidate), old, new)


def flips_by_partition(rows: DataFrame, old: Policy, new: Policy) -> DataFrame:
    """The same, with candidates equal to the flips: the threshold-free partition of a triple decides which score matters."""
    part, candidate = potential_partition("s", "r", "n"), F.lit(False)
    for name, score, a, b in (("support_capable", "s", old[0], new[0]), ("refute_capable", "r", old[1], new[1])):
        if a != b:
            candidate = candidate | ((part == name) & (F.col(score) >= min(a, b)) & (F.col(score) < max(a, b)))
    return _flips(rows.filter(candidate), old, new)


def withdrawn(current: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Current rows on withdrawn chunks."""
    return current.join(gone.select(key), key, "left_semi")


def contributions(decisions: DataFrame) -> DataFrame:
    """claim_id, label, text_hash, n: how many observations stand for a counted hash."""
    return decisions.filter("label <> 'neutral'").groupBy("claim_id", "label", "text_hash").agg(F.count(F.lit(1)).alias("n"))


def signed_deltas(flips: DataFrame) -> DataFrame:
    """claim_id, label, text_hash, delta: -1 for the old label and +1 for the new one, summed; zero sums drop out."""
    sides = F.array(F.struct(F.col("old_label").alias("label"), F.lit(-1).alias("d")), F.struct(F.col("new_label").alias("label"), F.lit(1).alias("d")))
    rows = flips.select("claim_id", "text_hash", F.explode(sides).alias("x")).filter("x.label <> 'neutral'")
    out = rows.groupBy("claim_id", F.col("x.label").alias("label"), "text_hash").agg(F.sum("x.d").alias("delta"))
    return out.filter("delta <> 0")


def crossings(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """claim_id, label, text_hash, crossing: +1 where a count leaves zero, -1 where it returns to zero."""
    rows = deltas.join(state, ["claim_id", "label", "text_hash"], "left").na.fill(0, ["n"])
    after = F.col("n") + F.col("delta")
    crossing = F.when((F.col("n") == 0) & (after > 0), 1).when((F.col("n") > 0) & (after == 0), -1)
    return rows.select("claim_id", "label", "text_hash", crossing.alias("crossing")).filter("crossing is not null")


def apply_crossings(states: DataFrame, crossed: DataFrame) -> DataFrame:
    """claim_id, support_count, refute_count and status moved by the crossings; claims without one keep their row. Best scores and listed
    ids don't follow from crossings, so they are not given."""
    moved = crossed.groupBy("claim_id").agg(*[F.sum(F.when(F.col("label") == x, F.col("crossing"))).alias(f"__{x}") for x in ("support", "refute")])
    rows = states.select("claim_id", "support_count", "refute_count").join(moved, "claim_id", "left").na.fill(0, ["__support", "__refute"])
    counts = [(F.col(f"{x}_count") + F.col(f"__{x}")).alias(f"{x}_count") for x in ("support", "refute")]
    return rows.select("claim_id", *counts).withColumn("status", claim_status("support_count", "refute_count"))


def override_counters(changes: DataFrame, key: str, delta: str) -> DataFrame:
    """Sum of signed deltas by object; zero sums drop out. A negative sum marks a broken history and is kept to be seen."""
    return changes.groupBy(key).agg(F.sum(delta).alias("overrides")).filter("overrides <> 0")
