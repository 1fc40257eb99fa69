"""The first items of every group, for views of the engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts a group is ranked in before its firsts are ranked together.
PARTS = 64


def first_items(df: DataFrame, group: Sequence[str], order: Sequence[tuple[str, bool]], item: str, limit: str, place: str = "place") -> DataFrame:
    """Group columns, ``item`` and ``place`` (1, 2, ...) of the first ``limit`` different items of every group.

    order: (numeric column, ascending) from first to last; null and NaN come last in either direction; equal orders are decided by the
    item. An item counts once, at its first place (an aggregation with map-side combine). A group is ranked in PARTS parts by a
    hash of the item and only the first ``limit`` of each part are ranked together, so no task sorts a whole large group. Rows
    with a null group column or item take no part; a ``limit`` that is null or below 1 gives a group no rows.
    """
    keys = []
    for name, ascending in order:
        value = F.col(name).cast("double")
        missing = value.isNull() | F.isnan(value)
        keys += [missing.alias(f"m_{name}"), F.when(missing, F.lit(0.0)).otherwise(value if ascending else -value).alias(f"o_{name}")]
    rows = df.filter(F.col(limit) >= 1).dropna(subset=[*group, item])
    best = rows.groupBy(*group, item).agg(F.min(F.struct(*keys)).alias("__o"), F.max(limit).alias("__n"))
    part = Window.partitionBy(*group, F.pmod(F.xxhash64(item), F.lit(PARTS))).orderBy("__o", item)
    cut = best.withColumn("__p", F.row_number().over(part)).filter("__p <= __n")
    ranked = cut.withColumn(place, F.row_number().over(Window.partitionBy(*group).orderBy("__o", item)))
    return ranked.filter(F.col(place) <= F.col("__n")).select(*group, item, place)
