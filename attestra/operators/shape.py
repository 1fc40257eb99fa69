"""Small helpers on the shape of frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One row from frames of one row each, without a join: their union, of which each column has one value."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in the order of ``key``, by range partitions that are numbered on their own and moved
    by the sizes of those before them: no task sees all rows. ``key`` should be unique."""
    sorted_rows = materialize(df.orderBy(key).withColumn("__m", F.monotonically_increasing_id()))
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(tuple(r) for r in sorted_rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    moved = df.sparkSession.createDataFrame(offsets, "__p bigint, __offset bigint")
    rows = sorted_rows.withColumn("__p", part).join(F.broadcast(moved), "__p")
    return rows.withColumn(name, place + F.col("__offset")).drop("__m", "__p", "__offset")
