"""Hall's condition, matchings and certificates against exhaustive search."""

import itertools
import random

from pyspark.sql import functions as F

from attestra.operators import matching as M

EDGES = "group_id int, ordinal int, text_hash string, observation_id string"


def largest(r, edges):
    """By trying every choice of hashes."""
    neighbours = [sorted({h for o, h in edges if o == i}) for i in range(r)]
    best = 0
    for choice in itertools.product(*[[None, *n] for n in neighbours]):
        used = [h for h in choice if h is not None]
        if len(set(used)) == len(used):
            best = max(best, len(used))
    return best


def build(spark, groups):
    edges = [(g, o, h, f"{h}-{o}") for g, (r, es) in groups.items() for o, h in es]
    requirements = [(g, o) for g, (r, _) in groups.items() for o in range(r)]
    return spark.createDataFrame(requirements, "group_id int, ordinal int"), spark.createDataFrame(edges, EDGES)


def test_sizes_and_certificates(spark):
    rng = random.Random(5)
    groups = {}
    for g in range(120):
        r = rng.randint(1, 4)
        groups[g] = (r, sorted({(rng.randrange(r), rng.choice("abcde")) for _ in range(rng.randint(0, 7))}))
    requirements, edges = build(spark, groups)
    want = {g: largest(r, es) for g, (r, es) in groups.items()}
    states = {x["group_id"]: x for x in M.group_states(requirements, edges).collect()}
    assert {g: x["matching_size"] for g, x in states.items()} == want
    assert {g: x["complete"] for g, x in states.items()} == {g: want[g] == groups[g][0] for g in groups}
    assert {x["group_id"]: x["matching_size"] for x in M.assignment_sizes(requirements, edges).collect()} == want
    rows = M.group_certificates(requirements, edges)
    assert M.invalid_certificates(rows, requirements, edges).count() == 0
    assert {x[0] for x in rows.select("group_id").collect()} == {g for g in groups if want[g] == groups[g][0]}
    assert M.certificate_digests(rows, "p").count() == len({x[0] for x in rows.select("group_id").collect()})


def test_one_hash_cannot_serve_two_requirements(spark):
    requirements, edges = build(spark, {1: (2, [(0, "h"), (1, "h")]), 2: (2, [(0, "h"), (1, "g")]), 3: (9, [(i, f"h{i}") for i in range(9)])})
    states = {x["group_id"]: (x["matching_size"], x["complete"]) for x in M.group_states(requirements, edges).collect()}
    assert states == {1: (1, False), 2: (2, True)}  # nine requirements are too many


def test_broken_certificates_are_found(spark):
    requirements, edges = build(spark, {1: (2, [(0, "h"), (1, "h"), (1, "g")])})
    bad = spark.createDataFrame([(1, 0, "h", "h-0"), (1, 1, "h", "h-1"), (2, 0, "x", "gone")], EDGES)
    assert {tuple(r) for r in M.invalid_certificates(bad, requirements, edges).collect()} == {(1, "repeated_hash"), (2, "dead_witness")}


def test_edge_deltas_and_masks(spark):
    counts = spark.createDataFrame([(1, 0, "h", 1), (1, 1, "h", 2)], "group_id int, ordinal int, text_hash string, n bigint")
    deltas = spark.createDataFrame([(1, 0, "h", -1), (1, 1, "h", -1), (1, 2, "h", 1), (1, 3, "h", 1), (1, 3, "h", -1)], "group_id int, ordinal int, text_hash string, delta int")
    changes = M.coalesce_edge_deltas(counts, deltas)
    assert {(r["ordinal"], r["before"], r["after"]) for r in changes.collect()} == {(0, 1, 0), (1, 2, 1), (2, 0, 1)}
    edges = spark.createDataFrame([(1, 0, "h", "a"), (1, 1, "h", "b"), (1, 1, "h", "c")], EDGES)
    assert tuple(M.mask_transitions(changes, edges).first()) == (1, "h", 0b011, 0b110)


def test_no_groups(spark):
    requirements, edges = build(spark, {1: (1, [])})
    nothing = requirements.filter(F.lit(False))
    assert M.group_states(nothing, edges).count() == 0
    assert M.group_states(requirements, edges).first()["matching_size"] == 0
