"""Top items of every group against brute force, with the awkward cases."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestra.llm.topn import LoserTree, merge_runs, top_n

HITS = "g string, rank int, score double, item string, n int, place string, seen int"


def best(rows):
    groups = defaultdict(list)
    nan = lambda x: x is None or x != x
    for g, rank, score, item, n, *_ in rows:
        if g is not None and item is not None and n is not None and n >= 1:
            groups[g, n].append((rank is None, rank or 0, nan(score), 0.0 if nan(score) else -score, item))
    out = []
    for (g, n), keys in groups.items():
        seen = []
        for key in sorted(keys):
            if key[-1] not in seen:
                seen.append(key[-1])
        out += [(g, item, i + 1) for i, item in enumerate(seen[:n])]
    return sorted(out)


def run(df, **options):
    got = top_n(df.drop("place"), ["g"], [("rank", True), ("score", False)], "item", "n", **options)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("partitions, fan_in, run_bytes", [(1, 512, 1 << 24), (6, 512, 1 << 24), (9, 2, 1), (9, 4, 0)])
def test_top_n_against_brute_force(spark, partitions, fan_in, run_bytes):
    rng = random.Random(partitions)
    limit = {"a": 3, "b": 1, "hot": 5, "c": 0, "d": None}
    rows = []
    for _ in range(1500):
        g = rng.choice(["a", "b", "c", "d", None] + ["hot"] * 6)
        score = rng.choice([None, float("nan"), 0.5, 0.25, -0.0, 0.0, 1.0, float("inf"), float("-inf")])
        rows.append((g, rng.choice([None, 1, 1, 2, 3, 7]), score, rng.choice([None, *"pqrstuvw"]), limit.get(g, 2), "clash", 1))
    df = spark.createDataFrame(rows + rows[:300], HITS).repartition(partitions)
    assert run(df, fan_in=fan_in, run_bytes=run_bytes) == best(rows)


def test_top_n_of_nothing(spark):
    assert run(spark.createDataFrame([], HITS)) == []


def test_group_larger_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = [("hot", i % 400, None, f"i{i % 700:04d}", 6, "", 0) for i in range(5000)] + [("cold", 1, 1.0, "x" * 5000, 2, "", 0)]
        assert run(spark.createDataFrame(rows, HITS).repartition(5)) == best(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 6)), max_size=12), max_size=9), st.integers(1, 8))
def test_loser_tree_merges_like_sorting(runs, n):
    runs = [sorted((a, b, (i, j)) for j, (a, b) in enumerate(run)) for i, run in enumerate(runs)]
    tree, merged = LoserTree(runs), []
    while (top := tree.head()) is not None:
        merged.append(runs[top[0]][top[1]])
        tree.move(top[1] + 1)
    assert merged == sorted(x for run in runs for x in run)
    seen = []
    for key in merged:
        if key[1] not in seen:
            seen.append(key[1])
    assert [k[1] for k in merge_runs(runs, n)] == seen[:n]


def test_writing_the_query_runs_no_job(spark):
    grouped = spark.range(1000).selectExpr("cast(id % 7 as string) g", "cast(id as int) rank", "rand() score", "cast(id as string) item", "3 n").groupBy("g", "item", "n").agg(F.max("rank").alias("rank"), F.max("score").alias("score"))
    spark.sparkContext.setJobGroup("writing", "")
    top_n(grouped, ["g"], [("rank", True), ("score", False)], "item", "n")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("writing")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs
