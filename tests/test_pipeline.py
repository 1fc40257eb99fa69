"""The change feed against brute force, with the awkward cases."""

import random

from attestra.operators.changefeed import fold_changes, live

FEED = "k string, seq bigint, op string, v string, seq2 int, extra string"


def folded(rows):
    best = {}
    for k, seq, op, v, *_ in rows:
        if k is None or seq is None:
            continue
        order = (seq, op is not None, op or "", v is not None, v or "")
        if k not in best or order > best[k][0]:
            best[k] = (order, op, v)
    return {k: (o[0], op, v) for k, (o, op, v) in best.items()}


def fold(df, base=None):
    return fold_changes(df, ["k"], ["seq"], "op", ["v"], base)


def as_dict(df):
    return {r["k"]: (r["seq"], r["op"], r["v"]) for r in df.collect()}


def test_changes_in_any_order_and_repeated(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([1, 2, 3, 4, None]), rng.choice(["insert", "delete", None]), rng.choice(["x", "y", None]), 0, "e") for _ in range(200)]
    want = folded(rows)
    for _ in range(2):
        rng.shuffle(rows)
        assert as_dict(fold(spark.createDataFrame(rows + rows[:50], FEED))) == want


def test_a_tombstone_stops_late_changes(spark):
    first = fold(spark.createDataFrame([("a", 5, "delete", None, 0, "")], FEED))
    late = spark.createDataFrame([("a", 4, "insert", "old", 0, ""), ("b", 1, "insert", "new", 0, "")], FEED)
    state = fold(late, first)
    assert as_dict(state)["a"] == (5, "delete", None)
    assert as_dict(live(state, "op")) == {"b": (1, "insert", "new")}


def test_folding_parts_is_folding_all(spark):
    rng = random.Random(9)
    rows = [(str(rng.randrange(20)), rng.randrange(50), rng.choice(["insert", "delete"]), str(rng.random()), 0, "") for _ in range(500)]
    half = fold(spark.createDataFrame(rows[:250], FEED))
    assert as_dict(fold(spark.createDataFrame(rows[250:], FEED), half)) == folded(rows)


def test_empty_feed(spark):
    assert as_dict(fold(spark.createDataFrame([], FEED))) == {}


def test_long_payload_and_one_hot_key(spark):
    rows = [("hot", i % 977, "insert", "x" * 20000 if i == 976 else "y", 0, "") for i in range(3000)] + [("cold", 1, "insert", "z", 0, "")]
    assert as_dict(fold(spark.createDataFrame(rows, FEED))) == folded(rows)


def test_first_items_of_every_group(spark):
    from attestra.operators.ranking import first_items

    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, 1, 2, 3]), rng.choice([None, float("nan"), 0.0, -0.0, 1.0, float("-inf")]), rng.choice([None, *"pqrstuvw"]), rng.choice([3])) for _ in range(600)]
    bad = lambda x: x is None or x != x
    want = []
    for g in ("hot", "a"):
        best = {}
        for k, rank, score, item, _ in rows:
            if k == g and item is not None:
                key = (rank is None, rank or 0, bad(score), 0.0 if bad(score) else -score, item)
                best[item] = min(best.get(item, key), key)
        want += [(g, item, i + 1) for i, item in enumerate(sorted(best, key=best.get)[:3])]
    df = spark.createDataFrame(rows, "g string, rank int, score double, item string, n int")
    got = first_items(df, ["g"], [("rank", True), ("score", False)], "item", "n").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert first_items(df.filter("false"), ["g"], [("rank", True)], "item", "n").count() == 0
