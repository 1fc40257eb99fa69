import random

import pytest

from attestra.llm import mixture as K


def test_shares_fill_up_and_spill_over():
    uses = K.plan_uses({"a": 1000, "b": 100, "c": 0}, {"a": (50.0, 2), "b": (40.0, 3), "c": (10.0, 5), "d": (None, 1)}, 1100)
    assert uses == {"a": pytest.approx(0.8), "b": 3.0, "c": 0.0, "d": 0.0}
    assert K.plan_uses({"a": 10}, {"a": (1.0, 2)}, 100) == {"a": 2.0}
    assert K.plan_uses({}, {}, 10) == {}


def test_flight_keeps_totals():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randint(0, 300)
        p, sizes = [rng.random() for _ in range(n)], [float(rng.choice([1, 2, 3, 50, 50, rng.randint(1, 500)])) for _ in range(n)]
        q = K.fly(p, sizes, rng)
        assert sum(0 < x < 1 for x in q) <= 2
        assert sum(q) == pytest.approx(sum(p), abs=1e-5) and sum(a * b for a, b in zip(q, sizes)) == pytest.approx(sum(a * b for a, b in zip(p, sizes)), rel=1e-6, abs=1e-3)
        assert set(K.land(q, rng)) <= {0.0, 1.0} and abs(sum(K.land(q, rng)) - sum(p)) < 1 + 1e-6


def test_inclusion_probabilities_hold():
    sizes = [float(x) for x in (1, 5, 9, 14, 30, 2, 2, 7, 11, 3)]
    counts = [0] * 10
    for seed in range(4000):
        rng = random.Random(seed)
        for i, x in enumerate(K.land(K.fly([0.3] * 10, sizes, rng), rng)):
            counts[i] += x
    assert all(abs(c / 4000 - 0.3) < 0.04 for c in counts)


DOCS = "doc_id bigint, source string, text string, tokens int, p double"
TARGETS = "source string, target_weight double, max_repeats int"


def mixed(spark, rows, targets, **options):
    chosen, report = K.mix(spark.createDataFrame(rows, DOCS), "doc_id", "source", "text", spark.createDataFrame(targets, TARGETS), **options)
    return chosen.collect(), {r["source"]: r for r in report.collect()}


def test_mix_reaches_its_shares(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["Big-Source", " big_source", "BIG_SOURCE", "small"]) if i % 20 else "other", " ".join(["word"] * rng.choice([0, 3, 10, 40, 400])), 0, 0.0) for i in range(1500)]
    rows += [(9000, None, "x", 0, 0.0), (9001, "small", None, 0, 0.0)]
    chosen, report = mixed(spark, rows, [("big_source", 3.0, 2), ("small", 1.0, 4), ("none", 1.0, 2)], block_rows=64)
    assert {r["source"] for r in chosen} == {"big_source", "small"}
    assert all(1 <= r["repeats"] <= {"big_source": 2, "small": 4}[r["source"]] for r in chosen)
    assert len({r["doc_id"] for r in chosen}) == len(chosen)
    total = sum(len((r[2] or "").split()) for r in rows)
    assert sum(r["tokens"] * r["repeats"] for r in chosen) == pytest.approx(total, rel=0.02)
    assert report["big_source"]["reached_share"] == pytest.approx(0.75, abs=0.01)
    assert report["none"]["mixed_tokens"] == 0 and report["none"]["planned_share"] == 0


def test_small_source_is_capped(spark):
    rows = [(i, "a", "w " * 20, 0, 0.0) for i in range(50)] + [(100 + i, "b", "w " * 20, 0, 0.0) for i in range(2)]
    chosen, report = mixed(spark, rows, [("a", 1.0, 9), ("b", 1.0, 3)])
    assert {r["repeats"] for r in chosen if r["source"] == "b"} == {3}
    assert report["b"]["reached_share"] < 0.2


def test_repeatable_and_empty(spark):
    rows = [(i, "a", "w " * (i % 7 + 1), 0, 0.0) for i in range(80)] + [(i, "b", "w", 0, 0.0) for i in range(100, 140)]
    targets = [("a", 1.0, 2), ("b", 9.0, 4)]
    assert sorted(map(tuple, mixed(spark, rows, targets)[0])) == sorted(map(tuple, mixed(spark, rows[::-1], targets)[0]))
    assert mixed(spark, [], targets)[0] == []
    assert mixed(spark, rows, [])[0] == []
