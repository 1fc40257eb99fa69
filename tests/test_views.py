"""Policy rules, states and deltas."""

import pytest
from pyspark.sql import functions as F

from attestra.functions.policy import argmax_label, decide
from attestra.operators import claims as C
from attestra.operators import deltas as D
from attestra.operators import temporal as T

TIES = [
    ((0.9, 0.05, 0.05), "support"), ((0.8, 0.1, 0.1), "support"), ((0.7, 0.1, 0.1), "neutral"), ((0.05, 0.9, 0.05), "refute"), ((0.1, 0.8, 0.1), "refute"),
    ((0.1, 0.7, 0.1), "neutral"), ((0.9, 0.9, 0.0), "refute"), ((0.0, 0.9, 0.9), "refute"), ((0.9, 0.0, 0.9), "neutral"), ((0.05, 0.05, 0.9), "neutral"), ((0.0, 0.0, 0.0), "neutral"),
]


def test_tie_table(spark):
    df = spark.createDataFrame([(*t, want) for t, want in TIES], "s double, r double, n double, want string")
    assert df.filter(decide("s", "r", "n", 0.8, 0.8) != F.col("want")).count() == 0
    other = spark.createDataFrame([(0.85, 0.85, 0.0)], "s double, r double, n double")
    assert other.select(decide("s", "r", "n", 0.8, 0.9)).first()[0] == "neutral"


def test_nan_and_null_never_reach_a_threshold(spark):
    df = spark.createDataFrame([(float("nan"), 0.0, 0.0), (None, 0.0, 0.0), (0.0, float("nan"), 0.0), (None, None, None)], "s double, r double, n double")
    assert {r[0] for r in df.select(decide("s", "r", "n", 0.5, 0.5)).collect()} == {"neutral"}
    assert df.select(argmax_label("s", "r", "n")).collect()[3][0] is None


CLAIMS = "claim_id int, answer_id int, required boolean"
DECISIONS = "claim_id int, label string, text_hash string, s double, r double, observation_id string"


def states(spark, rows, claims=((1, 1, True), (2, 1, True), (3, 1, False))):
    return {r["claim_id"]: r for r in C.claim_states(spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(rows, DECISIONS)).collect()}


def test_repeated_content_counts_once(spark):
    got = states(spark, [(1, "support", "h", 0.9, 0.0, "b"), (1, "support", "h", 0.95, 0.0, "a"), (2, "neutral", "h", 0.1, 0.0, "c")])
    assert (got[1]["support_count"], got[1]["support_ids"], got[1]["best_support"], got[1]["status"]) == (1, "a,b", 0.95, "supported")
    assert (got[2]["status"], got[2]["support_ids"], got[2]["best_support"]) == ("unsupported", "", None)
    assert got[3]["support_count"] == 0


@pytest.mark.parametrize(
    "labels, want",
    [(("support", "support"), "valid"), (("support", "neutral"), "partially_supported"), (("refute", "support"), "contradicted"), (("neutral", "neutral"), "unsupported")],
)
def test_answer_status(spark, labels, want):
    rows = [(i + 1, x, f"h{i}", 0.9, 0.9, str(i)) for i, x in enumerate(labels)]
    claims = spark.createDataFrame([(1, 1, True), (2, 1, True), (3, 1, False)], CLAIMS)
    answers = C.answer_states(C.claim_states(claims, spark.createDataFrame(rows, DECISIONS)))
    assert answers.first()["status"] == want


def test_empty_decisions(spark):
    assert {r["status"] for r in states(spark, []).values()} == {"unsupported"}


def test_overlay_hides_and_removes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    delta = spark.createDataFrame([(2, "B", False), (3, None, True), (4, "d", None)], "k int, v string, gone boolean")
    assert sorted(tuple(r) for r in T.overlay(base, delta, ["k"], F.col("gone")).collect()) == [(1, "a"), (2, "B"), (4, "d")]


def test_closed_working_history_does_not_bring_back_the_published_row(spark):
    published = spark.createDataFrame([(1, "p", 1, None), (2, "q", 1, None)], "k int, v string, valid_from int, valid_to int")
    working = spark.createDataFrame([(1, "w", 5, 0, 3)], "k int, v string, epoch int, from_revision int, to_revision int")
    at = lambda revision: sorted(tuple(r) for r in T.bitemporal_at(published, working, ["k"], 5, revision, "v").collect())
    assert at(2) == [(1, "w"), (2, "q")]
    assert at(3) == [(2, "q")]


def test_half_open_intervals(spark):
    df = spark.createDataFrame([(1, 5, 10), (2, 10, None), (3, 11, 12)], "k int, valid_from int, valid_to int")
    assert sorted(r["k"] for r in T.as_of(df, 10).collect()) == [2]
    bad = spark.createDataFrame([("a", 1, 5, 1), ("a", 5, None, 2), ("a", 7, 9, 3), ("b", 1, 9, 4), ("b", 3, 4, 5), ("b", 6, 8, 6)], "k string, valid_from int, valid_to int, id int")
    assert sorted(r["id"] for r in T.overlaps(bad, ["k"], ["id"]).collect()) == [3, 5, 6]


def test_crossings_only_at_zero(spark):
    state = spark.createDataFrame([(1, "support", "h", 2), (1, "support", "g", 1)], "claim_id int, label string, text_hash string, n bigint")
    deltas = spark.createDataFrame([(1, "support", "h", -1), (1, "support", "g", -1), (1, "refute", "g", 1)], "claim_id int, label string, text_hash string, delta bigint")
    assert sorted(tuple(r) for r in D.crossings(state, deltas).collect()) == [(1, "refute", "g", 1), (1, "support", "g", -1)]
