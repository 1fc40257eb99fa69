import hashlib
import json

import pytest
from pyspark.sql import functions as F

from attestra.functions.text import content_hash, fold, lexemes, line_slice, normalize, relative_path
from attestra.functions.digest import digest, hash_draw
from attestra.functions.models import cosine, embed, hash_logits, softmax
from attestra.operators import eventlog, runtime
from attestra.operators.paragraphs import evidence_units, pack, paragraph_chunks
from attestra.sources import corpus, jsonl
from attestra.sources.store import Store, append_new, write_report


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize("text", ["", "  ", "a\u00a0\u2003b\r\n c ", "\u3000x\x1c", "no change", "\u200bkeep"])
def test_normalization_is_that_of_python(spark, text):
    want = " ".join(text.split())
    assert one(spark, text, normalize) == want
    assert one(spark, text, content_hash) == hashlib.sha256(want.encode()).hexdigest()
    assert one(spark, text, fold) == text.strip().lower()


def test_lexemes_lines_and_paths(spark):
    assert one(spark, "Don't re-run: x_y Straße 3.5", lexemes) == ["don't", "re-run", "x", "y", "straße", "3", "5"]
    assert one(spark, "a\n b\nc", lambda x: line_slice(x, 2, 3)) == "b\nc\n"
    assert one(spark, "a", lambda x: line_slice(x, 1, 2)) is None
    assert [one(spark, p, relative_path) for p in ("a/b", "a\\b", "/a", "a//b", "a/../b", "", "c:/x")] == ["a/b", "a/b", None, None, None, None, None]


def test_digests(spark):
    want = hashlib.sha256(b"".join(len(x.encode()).to_bytes(8, "big") + x.encode() for x in ("ä", "b"))).hexdigest()
    assert one(spark, "ä", lambda x: digest(x, F.lit("b"))) == want
    draw = int(hashlib.sha256(b"s\x003").hexdigest()[:16], 16) % 10
    assert one(spark, "3", lambda x: hash_draw(F.lit(10), F.lit("s"), x)) == draw


def test_strict_lines_fail_on_bad_rows(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": "no"}\n')
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(tmp_path / "x.jsonl"), _schema(spark, "a int")).collect()


def _schema(spark, text):
    return spark.createDataFrame([], text).schema


def test_rejects_carry_their_reason(spark, tmp_path):
    lines = ['{"a": 1, "b": "x"}', '{"a": 1, "a": 2, "b": "x"}', "[1]", "{oops", '{"a": -1, "b": "x"}', '{"b": "x"}', "", '{"a": 2, "b": "y"}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    rows, rejects = jsonl.read_with_rejects(spark, str(tmp_path / "x.jsonl"), _schema(spark, "a int, b string"), {"negative_a": F.col("a") >= 0})
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "x"), (2, "y")]
    assert sorted(r["reason"] for r in rejects.collect()) == ["negative_a", "negative_a", "not_an_object", "not_json", "repeated_key"]


def test_corpus_scan_and_manifest(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.md").write_text("A")
    (tmp_path / "in/sub/b.md").write_text("Bé")
    rows = {r["relative_path"]: r for r in corpus.scan_directory(spark, str(tmp_path / "in"), "ns").collect()}
    assert {p: r["text"] for p, r in rows.items()} == {"a.md": "A", "sub/b.md": "Bé"}
    assert len({r["document_id"] for r in rows.values()}) == 2
    good = hashlib.sha256(b"A").hexdigest()
    manifest = spark.createDataFrame([("a.md", good), ("sub/b.md", good), ("c.md", good), ("../a.md", good)], "relative_path string, sha256 string")
    states = {r["relative_path"]: r["state"] for r in corpus.verify_files(spark, str(tmp_path / "in"), manifest).collect()}
    assert states == {"a.md": "ok", "sub/b.md": "changed", "c.md": "missing", "../a.md": "unsafe_path"}


def test_store_publishes_once(spark, tmp_path):
    store, df = Store(spark, str(tmp_path / "s")), spark.createDataFrame([(1, "a")], "k int, v string")
    assert store.head() is None
    assert store.publish(0, {"t": df}) and not store.publish(0, {"t": df.filter("k > 1")})
    assert store.publish(1, {"t": df.unionByName(df)})
    assert (store.head(), store.read("t").count(), store.read("t", 0).count()) == (1, 2, 1)
    write_report({"t": df}, str(tmp_path / "r"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "r/t")).first()["v"] == "a"
    jsonl.write_records(df, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == {"k": 1, "v": "a"}


def test_appending_is_idempotent_and_finds_conflicts(spark):
    log = spark.createDataFrame([("e1", "h1")], "id string, h string")
    events = spark.createDataFrame([("e1", "h1"), ("e2", "h2"), ("e2", "h2")], "id string, h string")
    assert [tuple(r) for r in append_new(events, log, "id", "h").collect()] == [("e2", "h2")]
    with pytest.raises(Exception, match="conflicting payload"):
        append_new(spark.createDataFrame([("e1", "other")], "id string, h string"), log, "id", "h").collect()
    fresh, clash = eventlog.new_events(events.unionByName(spark.createDataFrame([("e1", "x")], "id string, h string")), log, "id", "h")
    assert [tuple(r) for r in fresh.collect()] == [("e2", "h2")] and [tuple(r) for r in clash.collect()] == [("e1", "x")]


def test_epoch_state_machine():
    e = runtime.open_epoch(None, "ev", "p", ["root"])
    assert runtime.open_epoch(e, "ev", "p", ["root"]) is e
    with pytest.raises(runtime.Conflict):
        runtime.open_epoch(e, "ev", "q", [])
    with pytest.raises(runtime.Conflict):
        runtime.open_epoch(e, "other", "p", [])
    with pytest.raises(runtime.Conflict):
        runtime.seal(e, 0)
    e = runtime.complete(e, "root", "r", 0, children=["child"])
    assert runtime.complete(e, "root", "r", 99) is e
    with pytest.raises(runtime.Conflict):
        runtime.complete(e, "child", "c", 0)
    late = runtime.complete(e, "child", "c", 1, active=False, children=["never"])
    assert late.jobs == {"root": "completed", "child": "completed_inactive"}
    sealed = runtime.seal(late, 2)
    assert sealed.state == "sealed" and runtime.seal(sealed, 2) is sealed
    failed = runtime.fail(e, 1)
    assert runtime.complete(failed, "child", "c", 2, children=["x"]).jobs["child"] == "completed_inactive"
    with pytest.raises(runtime.Conflict):
        runtime.seal(failed, 2)


def test_job_checks(spark):
    changes = spark.createDataFrame([("pending", "leased"), ("completed", "leased"), ("leased", "completed")], "a string, b string")
    assert [tuple(r) for r in eventlog.bad_transitions(changes, "a", "b").collect()] == [("completed", "leased")]
    jobs, pairs = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    assert sorted(tuple(r) for r in eventlog.bijection_gaps(jobs, pairs, ["k"]).collect()) == [(2, 2, 0), (3, 0, 1)]
    flags = spark.createDataFrame([(True, False, None, True, True), (True, None, None, True, True), (True, True, True, True, False), (False, False, None, False, True)], "e boolean, r boolean, g boolean, c boolean, t boolean")
    got = [r[0] for r in flags.select(eventlog.attempt_reason(*[F.col(x) for x in "ergct"])).collect()]
    assert got == ["subject_inactive", "job_already_terminal", None, "epoch_failed"]


def test_paragraph_chunks(spark):
    text = "one\r\ntwo\n\n \nthree " + "x" * 30 + " four\n\n" + "y" * 50
    chunks = pack(text, 20)
    assert all(0 < len(c) <= 20 for c in chunks) and chunks[0] == "one\ntwo"
    assert "".join("".join(c.split()) for c in chunks) == "".join(text.split())
    cases = [
        ("x" * 1300 + "\n\nshort", [1200, 100, 5]), ("a" * 600 + " " + "b" * 599 + " " + "c" * 50, [600, 650]), ("a" * 600 + " " + "b" * 598 + " " + "c" * 50, [1199, 50]),
        ("p" * 600 + "\n\n" + "q" * 598, [1200]), ("p" * 600 + "\n\n" + "q" * 599, [600, 599]), ("k" * 10 + "\r\n\r\n" + "x" * 1201, [10, 1200, 1]), ("", []), (" \n \r\n", []), ("a\n \t\n\nb", [4]),
    ]
    for text, lengths in cases:
        assert [len(c) for c in pack(text, 1200)] == lengths
    df = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, "  ")], "k int, t string")
    assert [tuple(r) for r in paragraph_chunks(df, "k", "t").collect()] == [(1, 0, "a\n\nb")]
    units = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 1, "a"), (2, 1, " "), (3, 1, "z" * 2000)], "k int, i int, t string")
    assert {r["k"]: (r["unit"][:9], r["reason"]) for r in evidence_units(units, "k", "i", "t").collect()} == {1: ('["a","b"]', None), 2: ('[" "]', "empty"), 3: ('["zzzzzzz', "too_long")}


def test_model_stand_ins(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None)], "x string, y string")
    rows = df.select(embed(16)("x").alias("u"), embed(16)("y").alias("v"), hash_logits("x", "y").alias("l"))
    first, second = rows.select(cosine(F.col("u"), F.col("u")), cosine(F.col("u"), F.col("v")), F.aggregate(F.array(*softmax([F.col("l")[i] for i in range(3)], 2.0)), F.lit(0.0), lambda a, x: a + x)).collect()
    assert abs(first[0] - 1) < 1e-12 and -1 <= first[1] < 1 and abs(first[2] - 1) < 1e-12
    assert second[1] is None and second[2] is None
