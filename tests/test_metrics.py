import math
import random

import pytest
from pyspark.sql import functions as F

from attestra.operators import admission as A
from attestra.operators import metrics as M
from attestra.operators import records as R


def test_macro_ratio_of_nothing_is_null(spark):
    df = spark.createDataFrame([(0, 0, "a"), (1, 2, "b"), (1, 4, "b")], "n int, d int, c string")
    row = M.micro_macro(df, "n", "d", "c").first()
    assert (row["micro"], row["macro"], row["cluster_macro"]) == (2 / 6, 0.375, 2 / 6)
    assert M.micro_macro(df.filter("d = 0"), "n", "d", "c").first()["micro"] is None


def test_bins_hold_their_edges(spark):
    values = [k / 10 for k in range(11)] + [0.29999999999999998, 0.9999]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(M.bin_of(F.col("x"))).collect()] == [*range(10), 9, 2 if values[11] < 0.3 else 3, 9]


def test_temperature_is_found(spark):
    rng = random.Random(0)
    rows = []
    for _ in range(4000):
        logits = [rng.gauss(0, 1) for _ in range(3)]
        weights = [math.exp(x) for x in logits]
        rows.append((rng.choices(M.LABELS, weights)[0], *[2.5 * x for x in logits]))
    df = spark.createDataFrame(rows, "t string, a double, b double, c double")
    found, before, after = M.fit_temperature(df, "t", dict(zip(M.LABELS, "abc")))
    assert found == pytest.approx(2.5, rel=0.1) and after < before
    with pytest.raises(ValueError):  # labels that the scores never hint at push the temperature to its bound
        M.fit_temperature(df.withColumn("t", F.lit(M.LABELS[0])).filter("a < b"), "t", dict(zip(M.LABELS, "abc")))
    with pytest.raises(ValueError):
        M.fit_temperature(df.filter("false"), "t", dict(zip(M.LABELS, "abc")))


def test_components_of_a_path_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 102), (102, 100), (7, 7), (200, 200), (None, 5)]
    got = {r["node"]: r["component"] for r in R.components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in (100, 101, 102, 103)} | {200: 200}


def test_samples_are_bounded_and_repeatable(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(100)], "g int, i int")
    one, two = (sorted(r["i"] for r in R.group_bounded_sample(df, "g", "s", 40).collect()) for df in (rows, rows.repartition(3)))
    assert one == two and 0 < len(one) <= 40 and len(one) in (28, 29, 30)


def test_dedup_prefers_the_evaluation_split(spark):
    rows = spark.createDataFrame([("c", "train", 1), ("c", "test", 2), ("d", "train", 3), ("d", None, 4)], "c string, s string, i int")
    assert sorted(r["i"] for r in R.keep_best_split(rows, "c", "s", {"train": 1, "test": 2}).collect()) == [2, 3]


def test_search_in_blocks_is_exact(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.choice([0.0, 1.0, -1.0]) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame([*vectors, (99, None)], "k int, v array<float>").repartition(5)
    got = A.exact_top_k(df.withColumnRenamed("k", "q"), df, "q", "k", "v", 3, block=16)
    unit = {i: [x / (math.sqrt(sum(y * y for y in v)) or 1) for x in v] for i, v in vectors}
    want = []
    for q, a in unit.items():
        order = sorted(unit, key=lambda i: (-round(sum(x * y for x, y in zip(a, unit[i])), 12) + 0.0, i))
        want += [(q, i, n + 1) for n, i in enumerate(order[:3])]
    assert sorted((r["q"], r["item"], r["rank"]) for r in got.collect()) == sorted(want)
    assert A.exact_top_k(df.filter("k < 0").withColumnRenamed("k", "q"), df, "q", "k", "v", 3).count() == 0


def test_fusion_is_round_robin(spark):
    rng = random.Random(8)
    for case in range(4):
        channels = {c: rng.sample("abcdefghij", rng.randint(0, 8)) for c in ("vector", "lexical")}
        hits = [(1, item, c, n + 1, 4) for c, items in channels.items() for n, item in enumerate(items)]
        if not hits:
            continue
        got = A.fuse(spark.createDataFrame(hits, "g int, i string, channel string, rank int, budget int"), ["g"], "i", {"vector": 0, "lexical": 1}, "budget")
        want, turn = [], 0
        while len(want) < 4 and turn < 8:
            for c in ("vector", "lexical"):
                if turn < len(channels[c]) and channels[c][turn] not in want and len(want) < 4:
                    want.append(channels[c][turn])
            turn += 1
        assert [r["i"] for r in got.orderBy("fused_rank").collect()] == want, case


def test_refill_takes_the_best_of_the_reserve(spark):
    entries = spark.createDataFrame([("c", i, s, 1) for i, s in (("a", 0.9), ("b", 0.2), ("d", 0.7), ("e", 0.7), ("f", None))], "k string, i string, score double, rank int")
    covered = spark.createDataFrame([("c", "a"), ("z", "q")], "k string, i string")
    got = {r["k"]: (r["deficit"], r["refilled"], r["fresh_needed"]) for r in A.refill(entries, covered, "k", "i", 4, 0.5).collect()}
    assert got == {"c": (3, "d,e", True), "z": (3, "", True)}


def test_fitted_temperature_is_as_exact_as_it_is_given(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    truth = [int(np.argmax(v)) if rng.random() < 0.6 else int(rng.integers(3)) for v in x]
    df = spark.createDataFrame([(M.LABELS[t], *map(float, v)) for t, v in zip(truth, x)], "t string, a double, b double, c double")
    loss = lambda t: float(np.mean(np.log(np.exp(x / t).sum(1)) - x[np.arange(len(x)), truth] / t))
    lower, upper = math.log(0.05), math.log(20.0)
    for _ in range(200):
        c, d = lower + (upper - lower) / 3, upper - (upper - lower) / 3
        lower, upper = (lower, d) if loss(math.exp(c)) <= loss(math.exp(d)) else (c, upper)
    found, before, after = M.fit_temperature(df, "t", dict(zip(M.LABELS, "abc")))
    assert found == pytest.approx(math.exp(lower), rel=1e-4) and before == pytest.approx(loss(1.0)) and after == pytest.approx(loss(found))


def test_components_that_still_change_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    with pytest.raises(RuntimeError):
        R.components(edges, "a", "b", most_rounds=1)
    assert {r["component"] for r in R.components(edges, "a", "b").collect()} == {0}
