"""Deduplication, sampling and grouping of records."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def keep_best_split(rows: DataFrame, group: str, split: str, priority: dict[str, int]) -> DataFrame:
    """Rows of each group in the split of the greatest priority among its rows; splits without a priority drop out."""
    number = F.element_at(F.create_map(*[F.lit(x) for pair in priority.items() for x in pair]), F.col(split))
    rows = rows.withColumn("__p", number).filter(F.col("__p").isNotNull())
    best = rows.groupBy(group).agg(F.max("__p").alias("__best"))
    return rows.join(best, group).filter("__p = __best").drop("__p", "__best")


def first_per(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the least order; ``order`` should be total."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("__x"))
    return best.select(*[c if c in key else F.col(f"__x.{c}").alias(c) for c in rows.columns])


def shared_counts(a: DataFrame, b: DataFrame, columns: dict[str, Sequence[str]]) -> DataFrame:
    """name, shared: how many different values (of one or more columns) occur on both sides."""
    out = None
    for name, value in columns.items():
        one, two = (df.select(*value).dropna().distinct() for df in (a, b))
        part = one.join(two, list(value), "left_semi").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("shared"))
        out = part if out is None else out.unionByName(part)
    return out


def sample_draw(seed: str, *fields: str) -> Column:
    """The order of a deterministic sample: a hash over seed and fields."""
    return F.sha2(F.concat_ws("\u0000", F.lit(seed), *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256)


def stratified_sample(rows: DataFrame, stratum: str, page: str, case: str, seed: str, cases: int) -> DataFrame:
    """Of each stratum the first ``cases`` cases in the order of their hash, at most one of each page."""
    rows = rows.withColumn("draw", sample_draw(seed, stratum, page, case))
    one = first_per(rows, [stratum, page], ["draw", case])
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("draw", case))
    return one.withColumn("place", place).filter(F.col("place") <= cases).drop("draw")


def select_cases(rows: DataFrame, case: str, order: str, label: str, page: str, size: int, pattern: str, excluded: DataFrame, seed: str, most: int) -> DataFrame:
    """case, page (its least), place of the first ``most`` cases in the order of their hash: cases of ``size`` rows whose labels, joined in
    the order of ``order``, are LIKE ``pattern``, one of each page, none of an ``excluded`` page."""
    built = rows.groupBy(case).agg(F.sort_array(F.collect_list(F.struct(order, label))).alias("x"), F.min(page).alias(page)).filter(F.size("x") == size)
    good = built.filter(F.array_join(F.transform("x", lambda r: r[label]), "").like(pattern)).select(case, page).join(excluded.select(page), page, "left_anti")
    one = first_per(good.withColumn("draw", sample_draw(seed, page, case)), [page], ["draw", case])
    first = one.orderBy("draw", case).limit(most)  # few rows, so numbering them in one task is bounded
    return first.select(case, page, F.row_number().over(Window.orderBy("draw", case)).alias("place"))


def group_bounded_sample(rows: DataFrame, group: str, seed: str, most: int) -> DataFrame:
    """Whole groups in the order of their hash while their rows together stay within ``most``.

    The running sum works on one row a group with a size that the bound can hold, cut to the first ``most`` groups in order, which
    suffices because every group has a row.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("draw", sample_draw(seed, group))
    first = sizes.orderBy("draw", group).limit(most)
    total = F.sum("n").over(Window.orderBy("draw", group).rowsBetween(Window.unboundedPreceding, 0))
    chosen = first.withColumn("total", total).filter(F.col("total") <= most).select(group)
    return rows.join(chosen, group, "left_semi")


def components(edges: DataFrame, a: str, b: str, most_rounds: int | None = None) -> DataFrame:
    """node, component (its least node): connected components by alternating large-star and small-star steps.

    Every round maps edges to edges, its result is written to the shared checkpoint folder, and the loop ends when nothing changes;
    rounds grow with the logarithm of the longest path. If ``most_rounds`` are given and run out before, that is an error. Edges with a null end are ignored; loops make single nodes.
    """
    rows = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    nodes = rows.select("u").unionByName(rows.select(F.col("v").alias("u"))).distinct()
    current = materialize(rows.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small_star(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        linked = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return linked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    for done in itertools.count():
        if done == most_rounds:
            raise RuntimeError(f"components still change after {most_rounds} rounds")
        after = materialize(small_star(large_star(current).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")))
        before, current = current, after
        if before.count() == after.count() and before.join(after, ["u", "v"], "left_anti").isEmpty():
            break
    least = current.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(least, "u", "left").select(F.col("u").alias("node"), F.coalesce("component", "u").alias("component"))
