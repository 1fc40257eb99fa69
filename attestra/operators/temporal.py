"""Versions, intervals and overlays. Intervals are half-open, [from, to), with null for an open end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest order (null least), by one aggregation with map-side combine.

    Rows of equal order are decided by their other columns, so ``order`` should be total.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    best = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("__best"))
    return best.select(*[c if c in key else F.col(f"__best.{c}").alias(c) for c in df.columns])


def contains(point: Column | int, start: str | Column, end: str | Column) -> Column:
    point = F.lit(point) if isinstance(point, int) else point
    start, end = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return (start <= point) & (end.isNull() | (point < end))


def as_of(df: DataFrame, point: int, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    return df.filter(contains(point, start, end))


def interval_join(points: DataFrame, intervals: DataFrame, key: Sequence[str], point: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Points inside intervals of the same key: an equi-join on the key with the containment as its condition."""
    return points.join(intervals, list(key)).filter(contains(F.col(point), start, end))


def overlay(base: DataFrame, delta: DataFrame, key: Sequence[str], tombstone: Column) -> DataFrame:
    """``base`` without the keys that ``delta`` holds, and the rows of ``delta`` that are no tombstones."""
    kept = base.join(delta.select(*key), list(key), "left_anti")
    return kept.unionByName(delta.filter(~F.coalesce(tombstone, F.lit(False))).select(*base.columns))


def close_intervals(df: DataFrame, key: Sequence[str], start: str, end: str, tie: Sequence[str] = ()) -> DataFrame:
    """Versions with ``end``, the start of the next version of the key."""
    return df.withColumn(end, F.lead(start).over(Window.partitionBy(*key).orderBy(start, *tie)))


def overlaps(df: DataFrame, key: Sequence[str], tie: Sequence[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows that begin before an earlier row of their key has ended; empty if all intervals are disjoint."""
    order = Window.partitionBy(*key).orderBy(start, *tie)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__open", F.max(F.col(end).isNull()).over(before)).withColumn("__end", F.max(end).over(before))
    return rows.filter(F.coalesce("__open", F.lit(False)) | F.coalesce(F.col(start) < F.col("__end"), F.lit(False))).drop("__open", "__end")


def several_open(df: DataFrame, key: Sequence[str], end: str = "valid_to") -> DataFrame:
    """Keys with more than one open row, and how many."""
    return df.filter(F.col(end).isNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("open_rows")).filter("open_rows > 1")


def bitemporal_at(published: DataFrame, working: DataFrame, key: Sequence[str], epoch: int, revision: int, value: str) -> DataFrame:
    """What holds at (epoch, revision): a working row of the epoch that is open at the revision hides the published row as
    of the epoch before; a null value is a tombstone; a key that has any working history never falls back."""
    mine = working.filter(F.col("epoch") == epoch)
    now = mine.filter(contains(revision, "from_revision", "to_revision")).select(*key, value)
    before = as_of(published, epoch - 1).join(mine.select(*key).distinct(), list(key), "left_anti").select(*key, value)
    return before.unionByName(now.filter(F.col(value).isNotNull()))
