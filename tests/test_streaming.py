import random
from collections import defaultdict

from attestra.operators.changefeed import fold_changes
from attestra.sources.store import Store
from attestra.streaming.maintain import fold_stream, run_to_end, status_stream


def test_stream_of_changes_ends_like_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(6), rng.randrange(40), rng.choice(["insert", "delete"]), str(rng.randrange(9))) for _ in range(90)]
    kind = "k int, seq int, op string, v string"
    for i in range(3):
        spark.createDataFrame(rows[30 * i : 30 * i + 30], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        fold_stream(stream, store, "t", ["k"], ["seq"], "op", ["v"], str(tmp_path / "cp")).awaitTermination()
    want = fold_changes(spark.createDataFrame(rows, kind), ["k"], ["seq"], "op", ["v"])
    assert sorted(map(tuple, store.read("t").collect())) == sorted(map(tuple, want.collect()))
    assert store.head() == 2


def test_status_changes_follow_signed_contributions(spark, tmp_path):
    batches = [
        [(1, "support", "h", 1), (1, "support", "h", 1), (2, "refute", "g", 1), (3, "neutral", "x", 1)],
        [(1, "support", "h", -1), (2, "support", "h", 1)],
        [(1, "support", "h", -1), (2, "refute", "g", -1)],
    ]
    kind = "claim_id int, label string, text_hash string, delta int"
    seen, spec = [], str(tmp_path / "in")
    for batch in batches:
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(spec)
        changes = status_stream(spark.readStream.schema(kind).parquet(spec))
        run_to_end(changes, lambda df, _: seen.append(sorted((r["claim_id"], r["old_status"], r["new_status"]) for r in df.collect())), str(tmp_path / "cp"))
    flat = defaultdict(list)
    for rows in seen:
        for claim, old, new in rows:
            flat[claim].append((old, new))
    assert flat[1] == [("unsupported", "supported"), ("supported", "unsupported")]
    assert flat[2] == [("unsupported", "refuted"), ("refuted", "conflicted"), ("conflicted", "supported")]
    assert 3 not in flat
