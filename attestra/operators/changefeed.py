"""Applying a change feed: a commutative fold.

Per key the greatest struct (order, operation, payload) wins. ``max`` is commutative, associative and
idempotent, so repeated, late and disordered changes give the same state, Spark aggregates it on the map side
before the shuffle (a key with a third of all rows sends one row per task), and two folded states can be
folded again. Deletes stay in the folded state as tombstones, which keeps them effective against changes
that arrive after them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_changes(
    changes: DataFrame, key: Sequence[str], order: Sequence[str], op: str, payload: Sequence[str], base: DataFrame | None = None
) -> DataFrame:
    """The folded state: key, order, op and payload columns of the winning change of each key.

    changes: any rows; only the named columns are read, so further columns and their names don't matter.
    base: an earlier folded state (same columns), whose tombstones are kept.
    Order columns compare from left to right, null least; equal orders are decided by op, then payload, greatest
    first, so the result never depends on the arrival. Rows with a null in ``key`` or in the first order column
    have no place in the order and are left out. An empty feed gives an empty state.
    """
    columns = [*key, *order, op, *payload]
    rows = changes.select(*columns)
    if base is not None:
        rows = rows.unionByName(base.select(*columns))
    known = F.lit(True)
    for name in [*key, order[0]]:
        known = known & F.col(name).isNotNull()
    best = rows.filter(known).groupBy(*key).agg(F.max(F.struct(*order, op, *payload)).alias("__best"))
    return best.select(*key, *[F.col(f"__best.{name}").alias(name) for name in [*order, op, *payload]])


def live(state: DataFrame, op: str, deletes: Sequence[str] = ("delete",)) -> DataFrame:
    """The rows of a folded state that are no tombstones."""
    return state.filter(~F.coalesce(F.col(op).isin(list(deletes)), F.lit(False)))
