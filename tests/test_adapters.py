import random

from attestra.operators.adapters import adapt_subclaims
from attestra.operators.workload import event_stream, skewed_choice


def test_units_and_rejects(spark):
    parents = spark.createDataFrame(
        [("dev", "p", ["A.", "B.", " "]), ("dev", "twice", ["x"]), ("dev", "twice", ["y"]), ("test", "p", ["long " * 30])], "split string, parent_id string, sentences array<string>"
    )
    rows = [
        ("dev", "s1", "p", "support", [[1, 0, 1], [0, 1], [0]]), ("dev", "s2", "none", "support", [[0]]), ("dev", "s3", "twice", "support", [[0]]), ("dev", "s4", "p", "refute", []), ("dev", "s5", "p", None, [[7], [2], [], [0]]),
        ("test", "s6", "p", "support", [[0]]), ("dev", "s7", "p", "support", None),
    ]
    subclaims = spark.createDataFrame(rows, "split string, subclaim_id string, parent_id string, label string, evidence_sets array<array<int>>")
    units, rejects = adapt_subclaims(parents, subclaims, 100)
    assert sorted((r["subclaim_id"], r["set_ordinal"], r["text"]) for r in units.collect()) == [("s1", 0, "A. B."), ("s1", 2, "A."), ("s5", 3, "A.")]
    assert sorted((r["subclaim_id"], r["set_ordinal"], r["reason"]) for r in rejects.collect() if r["set_ordinal"] is not None) == [("s5", 0, "unknown_sentence"), ("s5", 1, "blank_sentence"), ("s5", 2, "empty_set"), ("s6", 0, "too_long")]
    assert sorted((r["subclaim_id"], r["reason"]) for r in rejects.collect() if r["set_ordinal"] is None) == [("s2", "no_parent"), ("s3", "repeated_parent"), ("s4", "no_evidence"), ("s7", "no_evidence")]


def test_workloads_repeat_and_stay_consistent():
    assert list(event_stream(3, 200)) == list(event_stream(3, 200))
    active = set()
    for _, kind, document, text, claim, scores in event_stream(5, 500):
        if kind == "insert":
            assert document not in active and text is not None
            active.add(document)
        elif kind in ("delete", "replace"):
            assert document in active
            active -= {document} if kind == "delete" else set()
        elif kind == "observe":
            assert claim is not None and len(scores) == 3
    picks = [skewed_choice(random.Random(i), 50, 5, 1.5) for i in range(300)]
    assert all(len(set(p)) == 5 for p in picks) and sum(0 in p for p in picks) > 4 * sum(40 in p for p in picks)
