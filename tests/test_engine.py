import random

from attestra.operators.engine import OBSERVATIONS, Engine
from attestra.sources.store import Store

CLAIMS = "claim_id string, answer_id string, required boolean"


def test_maintained_states_equal_a_full_recompute(spark, tmp_path):
    rng = random.Random(11)
    claims = spark.createDataFrame([(f"c{i}", f"a{i // 3}", i % 3 < 2) for i in range(9)], CLAIMS)
    engine = Engine(spark, Store(spark, str(tmp_path / "s")), claims)
    engine.start(0.8, 0.8)
    chunk = 0
    for version in range(1, 4):
        inserted, observed = [], []
        for document in rng.sample(["d0", "d1", "d2"], 2):
            inserted.append((f"k{chunk}", document, rng.choice(["h0", "h1", "h2"])))
            chunk += 1
        for i in range(12):
            scores = rng.choice([(0.9, 0.05, 0.05), (0.05, 0.9, 0.05), (0.7, 0.1, 0.1), (0.1, 0.1, 0.8)])
            observed.append((f"c{rng.randrange(9)}", f"k{rng.randrange(chunk + 1)}", version, f"o{version}-{i}", *scores))
        arguments = {
            "inserted": spark.createDataFrame(inserted, "chunk_id string, document_id string, text_hash string"),
            "deleted": spark.createDataFrame([("d2",)] if version == 2 else [], "document_id string"),
            "observed": spark.createDataFrame(observed, OBSERVATIONS),
            "policy": (0.6, 0.8) if version == 3 else None,
        }
        assert engine.apply(version, **arguments)
        assert not engine.apply(version, **arguments)
        assert engine.mismatches() == 0
    assert engine.store.head() == 3
    moved = [(r["old_status"], r["new_status"]) for r in engine.store.read("delta").collect()]
    assert all(a != b for a, b in moved)


def test_changes_are_laid_over_and_written_whole_in_the_end(spark, tmp_path, monkeypatch):
    from attestra.sources import store as S

    monkeypatch.setattr(S, "MOST_CHANGES", 2)
    store, want = Store(spark, str(tmp_path / "s")), {i: "old" for i in range(6)}
    store.publish(0, {"t": spark.createDataFrame(list(want.items()), "k int, v string"), "u": spark.range(3)})
    for version in range(1, 6):
        rows = {version % 6: f"v{version}", 10 + version: "new"}
        want |= rows
        assert store.publish(version, {}, changes={"t": (spark.createDataFrame(list(rows.items()), "k int, v string"), ["k"])})
        assert {r["k"]: r["v"] for r in store.read("t").collect()} == want
    assert not store.publish(3, {}) and store.read("u").count() == 3
    assert store.read("t", 0).count() == 6


def test_a_replay_changes_nothing_and_an_empty_batch_is_fine(spark, tmp_path):
    engine = Engine(spark, Store(spark, str(tmp_path / "s")), spark.createDataFrame([("c", "a", True)], CLAIMS))
    engine.start(0.8, 0.8)
    assert engine.apply(1) and not engine.apply(1) and engine.mismatches() == 0
    assert [r["status"] for r in engine.store.read("answer").collect()] == ["unsupported"]
