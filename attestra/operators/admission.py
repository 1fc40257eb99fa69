"""Candidate admission: exact vector search, lexical search, rank fusion and frontier repair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lexemes

#: Parameter: queries that are sent to the tasks at most; more are searched by blocks of this many rows of either side.
QUERY_BLOCK = 4096


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows of a column of vectors of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _units(values.reshape(len(column), -1))


def _best(query_keys: pa.Array, queries: np.ndarray, item_keys: pa.Array, items: np.ndarray, k: int | None, floor: float, names: list[str]) -> pa.Table:
    """The k items of greatest cosine of each query, ties by the smaller item; all of at least ``floor`` without k."""
    s = np.round(np.clip(queries @ items.T, -1.0, 1.0), 12)
    if k is None:
        row, col = np.nonzero(s >= floor)
    else:
        by_name = np.argsort(np.array(item_keys.to_pylist(), dtype=object), kind="stable")
        order = by_name[np.argsort(-s[:, by_name], axis=1, kind="stable")[:, :k]]
        row, col = np.repeat(np.arange(len(queries)), order.shape[1]), order.ravel()
    return pa.table([query_keys.take(pa.array(row)), item_keys.take(pa.array(col)), pa.array(s[row, col], pa.float64())], names)


def _against_all(queries: DataFrame, items: DataFrame, query_key: str, item_key: str, vector: str, k: int | None, block: int, floor: float = -1.0) -> DataFrame:
    """Each query against every item: up to ``block`` queries are sent to the tasks that scan the items; more of them, and the items, are
    dealt to blocks by a hash of their key, and each pair of blocks is one task's group. No side passes the driver beyond the bound."""
    rows = items.select(F.col(item_key).alias("k"), F.col(vector).alias("v")).dropna()
    wanted = queries.select(F.col(query_key).alias("q"), F.col(vector).alias("w")).dropna()
    schema = f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}, item {items.schema[item_key].dataType.simpleString()}, similarity double"
    names = [query_key, "item", "similarity"]
    few = wanted.limit(block + 1).toArrow()
    if not few.num_rows:
        return items.sparkSession.createDataFrame([], schema)
    if few.num_rows <= block:
        keys, vectors = few["q"].combine_chunks(), _matrix(few["w"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield from _best(keys, vectors, batch["k"], _matrix(batch["v"]), k, floor, names).to_batches()

        return rows.mapInArrow(run, schema)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _best(left["q"].combine_chunks(), np.zeros((0, 1)), right["k"].combine_chunks(), np.zeros((0, 1)), None, 2.0, names)
        return _best(left["q"].combine_chunks(), _matrix(left["w"]), right["k"].combine_chunks(), _matrix(right["v"]), k, floor, names)

    sizes = [max(1, -(-n // block)) for n in (wanted.count(), rows.count())]
    left = wanted.withColumn("bq", F.pmod(F.xxhash64("q"), F.lit(sizes[0]))).withColumn("bi", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(sizes[1] - 1).cast("bigint"))))
    right = rows.withColumn("bi", F.pmod(F.xxhash64("k"), F.lit(sizes[1]))).withColumn("bq", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(sizes[0] - 1).cast("bigint"))))
    return left.groupBy("bq", "bi").cogroup(right.groupBy("bq", "bi")).applyInArrow(one, schema)


def exact_top_k(queries: DataFrame, items: DataFrame, query_key: str, item_key: str, vector: str, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """query key, item, rank (1..k), similarity: the k items of greatest cosine of every query, ties by the smaller item.

    Exact: every query meets every item once in a matrix product, and each task keeps its own k best, so the last shuffle
    carries k rows for each query and block. Null keys and vectors take no part.
    """
    found = _against_all(queries, items, query_key, item_key, vector, k, block)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.col("similarity").desc(), "item"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(query_key, "item", "rank", "similarity")


def full_pairs(queries: DataFrame, items: DataFrame, query_key: str, item_key: str, vector: str, floor: float, block: int = QUERY_BLOCK) -> DataFrame:
    """Every pair of a stated set of queries and the items with a cosine of at least ``floor``: the exhaustive audit."""
    return _against_all(queries, items, query_key, item_key, vector, None, block, floor)


def recall(exact: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, expected, hit, recall of each query; recall is null where nothing was expected."""
    rows = exact.select(key, "item").join(found.select(key, "item", F.lit(1).alias("hit")), [key, "item"], "left")
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("hit"))
    return out.withColumn("recall", F.col("hit") / F.col("expected"))


# lexical search


def lexeme_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, lexeme, n: the different lexemes of each text and how often each occurs."""
    return df.select(key, F.explode(lexemes(F.col(text))).alias("lexeme")).groupBy(key, "lexeme").agg(F.count(F.lit(1)).alias("n"))


def document_frequency(rows: DataFrame, total: DataFrame) -> DataFrame:
    """lexeme, df, idf = ln((C + 1) / (df + 1)), C being the number of texts (``total``: one row of one column)."""
    counts = rows.groupBy("lexeme").agg(F.count(F.lit(1)).alias("df"))
    return counts.select("lexeme", "df", F.log((total.scalar() + 1) / (F.col("df") + 1)).alias("idf"))


def query_lexemes(queries: DataFrame, key: str, frequency: DataFrame, total: DataFrame, most: int = 32) -> DataFrame:
    """key, lexeme, place: the ``most`` rarest different lexemes of each query, ties by the lexeme."""
    rows = queries.join(frequency.select("lexeme", "idf"), "lexeme", "left")
    rows = rows.withColumn("idf", F.round(F.coalesce("idf", F.log(total.scalar() + 1)), 9))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("idf").desc(), "lexeme"))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select(key, "lexeme", "place")


def lexical_search(queries: DataFrame, index: DataFrame, key: str, item: str, limit: int, cover: bool) -> DataFrame:
    """key, item, rank, score of the best ``limit`` items of each query.

    Score is x / (x + 1) with x the number of shared lexemes or, with ``cover``, the cover density of the query's
    lexemes joined by OR: a tenth of the number of their occurrences.
    """
    value = F.sum("n") * F.lit(0.1) if cover else F.count(F.lit(1)).cast("double")
    rows = queries.select(key, "lexeme").join(index, "lexeme").groupBy(key, item).agg(value.alias("x"))
    rows = rows.withColumn("score", F.round(F.col("x") / (F.col("x") + 1), 12))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), item))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit).select(key, item, "rank", "score")


# fusion and frontier


def bad_ranks(hits: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose ranks are not 1..n without gap or repeat, with n and the number of different ranks."""
    out = hits.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count_distinct("rank").alias("different"))
    good = (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("different") == F.col("n"))
    return out.filter(~F.coalesce(good, F.lit(False))).select(*key, "n", "different")


def conflicts(hits: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys that occur with different values, and how many: repeats of equal rows are no conflict."""
    return hits.select(*key, *values).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1")


def fuse(hits: DataFrame, group: list[str], item: str, channels: dict[str, int], limit: str) -> DataFrame:
    """group, item, fused_rank: round-robin over channels in the order of their number, each item at its first turn, cut at
    ``limit`` items a group. hits: group, item, channel, rank (1..n without gaps), limit.

    The first ``limit`` ranks of each channel decide, so the rest is dropped before the shuffle.
    """
    order = F.create_map(*[F.lit(x) for pair in channels.items() for x in pair])
    turn = F.struct("rank", F.element_at(order, F.col("channel")).alias("turn"))
    rows = hits.filter(F.col("channel").isin(list(channels)) & (F.col("rank") <= F.col(limit)))
    first = rows.groupBy(*group, item, limit).agg(F.min(turn).alias("turn"))
    fused = F.row_number().over(Window.partitionBy(*group).orderBy("turn", item))
    return first.withColumn("fused_rank", fused).filter(F.col("fused_rank") <= F.col(limit)).select(*group, item, "fused_rank")


def add_lineage(fused: DataFrame, lineage: DataFrame, group: list[str], item: str) -> DataFrame:
    """``fused`` and the lineage items not in it, ranked on by item; mandatory: whether lineage names the item."""
    rest = lineage.select(*group, item).distinct()
    rows = fused.join(rest.withColumn("mandatory", F.lit(True)), [*group, item], "full").na.fill(False, ["mandatory"])
    order = Window.partitionBy(*group).orderBy(F.col("fused_rank").asc_nulls_last(), item)
    return rows.select(*group, item, F.row_number().over(order).alias("fused_rank"), "mandatory")


def refill(entries: DataFrame, covered: DataFrame, key: str, item: str, depth: int, floor: float) -> DataFrame:
    """key, deficit, refilled (items, comma-joined in order), fresh_needed: what each frontier lacks to ``depth`` and takes from its
    reserve: entries of at least ``floor`` that are not covered, by score (descending), rank and item.

    entries: key, item, score, rank; covered: key, item of the current verified pairs.
    """
    have = covered.select(key, item).distinct()
    counts = have.groupBy(key).agg(F.count(F.lit(1)).alias("have"))
    keys = entries.select(key).unionByName(covered.select(key)).distinct().join(counts, key, "left").na.fill(0, ["have"])
    keys = keys.select(key, F.greatest(F.lit(0), F.lit(depth) - F.col("have")).cast("int").alias("deficit"))
    reserve = entries.filter(F.col("score") >= floor).groupBy(key, item).agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    reserve = reserve.join(have, [key, item], "left_anti")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "rank", item))
    taken = reserve.withColumn("place", place).filter(F.col("place") <= depth).join(keys, key).filter("place <= deficit")
    lists = taken.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", item))).alias("x"), F.count(F.lit(1)).alias("n"))
    out = keys.filter("deficit > 0").join(lists, key, "left").na.fill(0, ["n"])
    names = F.coalesce(F.array_join(F.transform("x", lambda x: x[item].cast("string")), ","), F.lit(""))
    return out.select(key, "deficit", names.alias("refilled"), (F.col("n") < F.col("deficit")).alias("fresh_needed"))


def owners(hits: DataFrame, pair: list[str], root: str, reason: str) -> DataFrame:
    """pair, owner (least root), reasons (different, sorted, comma-joined): one row for each pair that several roots found."""
    return hits.groupBy(*pair).agg(F.min(root).alias("owner"), F.array_join(F.sort_array(F.collect_set(reason)), ",").alias("reasons"))


def coverage(wanted: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """key, artifacts, state of the wanted keys: missing (0), complete (1) or ambiguous (more)."""
    counts = artifacts.groupBy(key).agg(F.count(F.lit(1)).alias("artifacts"))
    rows = wanted.select(key).distinct().join(counts, key, "left").na.fill(0, ["artifacts"])
    state = F.when(F.col("artifacts") == 0, "missing").when(F.col("artifacts") == 1, "complete").otherwise("ambiguous")
    return rows.withColumn("state", state)
