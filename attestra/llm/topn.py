"""The N best items of every group by merging sorted runs with a loser tree.

1. Runs. Every scan task sorts its own rows by (group, order) and cuts each group after its first N different
   items: a group of millions of rows leaves at most N rows in a run. No shuffle happens before that cut.
2. Store. The shuffle holds the runs bucketed by group: one sorted block per run and bucket.
3. Merge. A task merges the runs of each group of its bucket with a loser tree; once a group has its N items, the
   merge seeks to the next group without looking at the rest of its runs. A task holds one batch and one group of
   cut runs. Inputs that may have more scan tasks than ``fan_in`` are merged in two passes.

A group's rows in the last merge number at most N times ``fan_in``, whatever its size. The result has N rows a
group at most and doesn't depend on partitioning or on the number of passes: the order is total (the item ends it)
and a row equal to another in all of these columns adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LoserTree:
    """Merges sorted runs of comparable keys: each inner node holds the loser of its two sides, so a step costs
    one comparison a level. ``runs[i][j]`` are keys in ascending order."""

    def __init__(self, runs: Sequence[Sequence[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        size = 1
        while size < len(runs):
            size *= 2
        self.size, self.losers = size, [0] * size
        winners = [0] * size + list(range(size))
        for node in range(size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            win, lose = (b, a) if self._before(b, a) else (a, b)
            winners[node], self.losers[node] = win, lose
        self.winner = winners[1] if size > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        if a >= len(self.runs) or self.at[a] >= len(self.runs[a]):
            return False
        if b >= len(self.runs) or self.at[b] >= len(self.runs[b]):
            return True
        return self.runs[a][self.at[a]] < self.runs[b][self.at[b]]

    def head(self) -> tuple[int, int] | None:
        """Run and position of the least key, or None when all runs are used up."""
        w = self.winner
        return None if w >= len(self.runs) or self.at[w] >= len(self.runs[w]) else (w, self.at[w])

    def move(self, position: int) -> None:
        """Puts the winning run at ``position`` and plays its path again."""
        w = self.winner
        self.at[w] = position
        node = (w + self.size) // 2
        while node:
            if self._before(self.losers[node], w):
                self.losers[node], w = w, self.losers[node]
            node //= 2
        self.winner = w


def merge_runs(runs: Sequence[Sequence[tuple]], n: int) -> list[tuple]:
    """The first ``n`` keys with different items over all runs, least first. A key ends with its item and the row's number."""
    tree, seen, out = LoserTree(runs), set(), []
    while len(out) < n and (top := tree.head()) is not None:
        run, at = top
        key = runs[run][at]
        if key[-2] not in seen:
            seen.add(key[-2])
            out.append(key)
        tree.move(at + 1)
    return out


def _cut_runs(columns: list[str], group: list[str], item: str, limit: str):
    """Keeps of each group in a sorted stream the first ``limit`` different items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pd.DataFrame | None = None

        def first(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows[~rows.duplicated([*group, item])]
            return rows[rows.groupby(group, sort=False).cumcount().to_numpy() < rows[limit].to_numpy()]

        for batch in batches:
            rows = batch.to_pandas()
            if rest is not None:
                rows = pd.concat([rest, rows], ignore_index=True)
            if rows.empty:
                continue
            kept = first(rows)
            last = np.logical_and.reduce([kept[g].to_numpy() == kept[g].iloc[-1] for g in group])
            rest = kept[last]
            if not last.all():
                yield pa.RecordBatch.from_pandas(kept[~last][columns], preserve_index=False)
        if rest is not None and len(rest):
            yield pa.RecordBatch.from_pandas(rest[columns], preserve_index=False)

    return cut


def _merge_bucket(group: list[str], keys: list[str], item: str, limit: str, run: str, place: str):
    """Merges the runs of each group in a stream sorted by (group, run, order); emits the columns read and ``place``."""

    def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for batch in batches:
            rows = batch.to_pandas()
            if rows.empty:
                continue
            last = np.logical_and.reduce([rows[g].to_numpy() == rows[g].iloc[-1] for g in group])
            cut = len(rows) - int(np.argmin(last[::-1])) if not last.all() else 0
            if rest and (cut or any(rest[0][g].iloc[-1] != rows[g].iloc[0] for g in group)):
                yield pd.concat([*rest, rows[:cut]], ignore_index=True)
                rest = []
            elif cut:
                yield rows[:cut].reset_index(drop=True)
            rest.append(rows[cut:])
        if rest:
            yield pd.concat(rest, ignore_index=True)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            new_group = np.zeros(len(rows), bool)
            new_group[0] = True
            for g in group:
                value = rows[g].to_numpy()
                new_group[1:] |= value[1:] != value[:-1]
            number = np.cumsum(new_group) - 1
            run_of = rows[run].to_numpy()
            new_run = new_group.copy()
            new_run[1:] |= run_of[1:] != run_of[:-1]
            several = np.bincount(number, weights=new_run) > 1
            taken = ~several[number]  # a single run is in order and cut already
            places = np.arange(len(rows)) - np.flatnonzero(new_group)[number] + 1
            mixed = np.flatnonzero(~taken)
            table = dict(zip(mixed.tolist(), zip(*[rows[c].to_numpy()[mixed].tolist() for c in [*keys, item]])))
            n_of = rows[limit].to_numpy()
            starts, run_starts = np.append(np.flatnonzero(new_group), len(rows)), np.flatnonzero(new_run)
            for k in np.flatnonzero(several):
                lo, hi = int(starts[k]), int(starts[k + 1])
                inner = run_starts[np.searchsorted(run_starts, lo) : np.searchsorted(run_starts, hi)].tolist()
                runs = [[(*table[j], j) for j in range(a, b)] for a, b in zip(inner, [*inner[1:], hi])]
                for rank, key in enumerate(merge_runs(runs, int(n_of[lo])), 1):
                    taken[key[-1]], places[key[-1]] = True, rank
            rows[place] = places.astype("int32")
            yield pa.RecordBatch.from_pandas(rows[taken], preserve_index=False)

    return merge


def _scan_bytes(df: DataFrame) -> int:
    """Bytes that the plan's leaves are estimated to hold; nothing is run for it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def top_n(
    df: DataFrame, group: Sequence[str], order: Sequence[tuple[str, bool]], item: str, limit: str, place: str = "place", fan_in: int = 512, run_bytes: int = 1 << 24
) -> DataFrame:
    """Group columns, ``item`` and ``place`` (1, 2, ...) of the first ``limit`` different items of every group.

    order: (numeric column, ascending) from first to last; null and NaN come last in either direction, behind the
    infinities. Equal orders are decided by the item, ascending by bytes. An item counts once, at its first place.
    ``limit`` is an integer column, the same within a group; null or below 1 gives the group no rows. Rows with a null
    group column or item take no part; an empty table gives an empty result; only the named columns are read.
    Inputs of more than ``fan_in`` times ``run_bytes`` bytes, so of more runs than that, are merged in two passes.
    """
    group, keys, sorts = list(group), [], []
    for name, ascending in order:
        value = F.col(name).cast("double")
        missing = value.isNull() | F.isnan(value)
        sorts.append(missing.alias(f"__m_{name}"))
        sorts.append(F.when(missing, F.lit(0.0)).otherwise((value if ascending else -value) + F.lit(0.0)).alias(f"__o_{name}"))  # -0.0 and 0.0 are equal
        keys += [f"__m_{name}", f"__o_{name}"]
    known = (F.col(limit) >= 1) & F.col(item).isNotNull()
    for name in group:
        known = known & F.col(name).isNotNull()
    rows = df.filter(known).select(*group, *sorts, item, F.col(limit).cast("int").alias("__n"))
    rows = rows.sortWithinPartitions(*group, *keys, item)
    rows = rows.mapInArrow(_cut_runs(rows.columns, group, item, "__n"), rows.schema).withColumn("__run", F.spark_partition_id())
    placed = T.StructType([*rows.schema.fields, T.StructField(place, T.IntegerType())])
    if _scan_bytes(df) > fan_in * run_bytes:
        rows = rows.withColumn("__run", F.expr(f"__run % {max(1, fan_in)}")).withColumn("__part", F.spark_partition_id())
        passes = T.StructType([*rows.schema.fields, T.StructField(place, T.IntegerType())])
        rows = rows.repartition(*group, "__run").sortWithinPartitions(*group, "__run", "__part", *keys, item)
        rows = rows.mapInArrow(_merge_bucket([*group, "__run"], keys, item, "__n", "__part", place), passes).drop("__part", place)
    rows = rows.repartition(*group).sortWithinPartitions(*group, "__run", *keys, item)
    return rows.mapInArrow(_merge_bucket(group, keys, item, "__n", "__run", place), placed).select(*group, item, place)
