"""Point patches: changes of keyed state as rows with what was before and what comes after, applied only where the former still holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .claims import differences


def prepare(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, before, after (structs of ``columns``, null where the key is absent) of the keys that change."""
    return differences(before, after, key, columns)


def conflicts(current: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, expected, found of the keys whose current row is not the one the patch was prepared on. A patch with conflicts must not be applied."""
    now = current.select(key, F.struct(*columns).alias("found"))
    rows = patch.select(key, F.col("before").alias("expected")).join(now, key, "left")
    return rows.filter(~F.col("expected").eqNullSafe(F.col("found")))


def apply(current: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and ``columns`` with the patch over them: also the preview of a patch, for nothing is written. A null after removes the key."""
    kept = current.select(key, *columns).join(patch.select(key), key, "left_anti")
    return kept.unionByName(patch.filter(F.col("after").isNotNull()).select(key, *[F.col(f"after.{c}").alias(c) for c in columns]))


def inverse(patch: DataFrame, key: str) -> DataFrame:
    """The patch that takes back a patch."""
    return patch.select(key, F.col("after").alias("before"), F.col("before").alias("after"))


def judgment_faults(judgments: DataFrame, claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """claim_id, chunk_id, reason of judgments that no recompute may use: duplicate_pair, unknown_claim, unknown_chunk; a pair can have several."""
    pairs = judgments.select("claim_id", "chunk_id")
    twice = pairs.groupBy("claim_id", "chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("claim_id", "chunk_id", F.lit("duplicate_pair").alias("reason"))
    claim = pairs.join(claims.select("claim_id"), "claim_id", "left_anti").select("claim_id", "chunk_id", F.lit("unknown_claim").alias("reason"))
    chunk = pairs.join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("claim_id", "chunk_id", F.lit("unknown_chunk").alias("reason"))
    return twice.unionByName(claim).unionByName(chunk).distinct()


def label_of(label: str, names: dict[str, str]):
    """The mapped label of a column, folded; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.lower(F.trim(F.col(label))))


# checks of stored relations


def bad_ordinals(rows: DataFrame, group: str, ordinal: str, most: int = 8) -> DataFrame:
    """group, members, reason of groups that have no or too many members (size), or whose ordinals are not 0, 1, ... (gap)."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"), F.count_distinct(ordinal).alias("d"))
    dense = (F.col("lo") == 0) & (F.col("hi") == F.col("members") - 1) & (F.col("d") == F.col("members"))
    return counts.select(group, "members", F.when(F.col("members") > most, "size").when(~dense, "gap").alias("reason")).filter("reason is not null")


def not_append_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``old`` that ``new`` no longer has: those an append-only table has lost or changed. Null-safe in all columns; repeats count."""
    return old.exceptAll(new.select(*old.columns))


def wrong_counters(stored: DataFrame, recounted: DataFrame, key: str, counter: str) -> DataFrame:
    """key, stored, recounted of the counters that don't agree; a key on one side only has 0 on the other."""
    rows = stored.select(key, F.col(counter).alias("stored")).join(recounted.select(key, F.col(counter).alias("recounted")), key, "full").na.fill(0, ["stored", "recounted"])
    return rows.filter("stored <> recounted")
