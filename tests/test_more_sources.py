import hashlib
import struct
import subprocess

import pytest
from pyspark.sql import functions as F

from attestra.functions.digest import digest_of, f64_hex, typed_fields
from attestra.operators import admission as A
from attestra.operators import resampling as B
from attestra.session import ensure_checkpoint_dir
from attestra.sources.revision import read_revision
from attestra.sources.store import bar_chart, bundle_manifest


def test_typed_digests(spark):
    df = spark.createDataFrame([("1", 1, 1.5, True), (None, None, None, None), ("1", -3, -0.0, False)], "a string, b int, c double, d boolean")
    fields = typed_fields(("str", F.col("a")), ("int", F.col("b")), ("f64", F.col("c")), ("bool", F.col("d")))
    got = df.select(fields.alias("f"), digest_of(fields).alias("h")).collect()
    assert got[0]["f"] == ["str", "1", "int", "1", "f64", struct.pack(">d", 1.5).hex(), "bool", "true"]
    assert got[1]["f"] == ["null"] * 4 and got[2]["f"][5] == struct.pack(">d", -0.0).hex()
    framed = b"".join(struct.pack(">q", len(x)) + x for x in (t.encode() for t in got[0]["f"]))
    assert got[0]["h"] == hashlib.sha256(framed).hexdigest()
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([(float("inf"),)], "c double").select(f64_hex("c")).collect()


def test_a_pinned_revision(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True).stdout.decode().strip()
    git("init", "-q")
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "b.txt").write_bytes(b"\xff two")
    git("add", "-A")
    git("commit", "-qm", "first")
    first = git("rev-parse", "HEAD")
    (tmp_path / "a.txt").write_text("changed")
    git("commit", "-qam", "second")
    got = {r["path"]: r["text"] for r in read_revision(spark, str(tmp_path), first).collect()}
    assert got == {"a.txt": "one", "sub dir/b.txt": "\ufffd two"}
    assert [r["path"] for r in read_revision(spark, str(tmp_path), first, "sub dir").collect()] == ["sub dir/b.txt"]
    with pytest.raises(ValueError):
        read_revision(spark, str(tmp_path), "HEAD")


def test_bundles_and_charts(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    one, two = bundle_manifest({"t": a}), bundle_manifest({"t": a.repartition(3).select("v", "k")})
    assert one == two and one["t"]["rows"] == 3
    assert bundle_manifest({"t": a.filter("k = 2")})["t"]["sha256"] != one["t"]["sha256"]
    assert bundle_manifest({"t": a.filter("false")})["t"]["rows"] == 0
    chart = bar_chart([("a<b", 2.0), ("c", 0.0)], "times")
    assert chart.count("<rect") == 2 and "a&lt;b" in chart and bar_chart([], "none").startswith("<svg")


def test_many_queries_are_searched_by_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    make = lambda n, name: spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(n)] + [(None, [0.0] * 4), (999, None)], f"{name} int, v array<double>")
    queries, items = make(45, "q"), make(70, "i")
    few, many = (sorted(map(tuple, A.exact_top_k(queries, items, "q", "i", "v", 3, block=b).collect())) for b in (4096, 10))
    assert few == many and len(few) == 135
    pairs = [sorted(map(tuple, A.full_pairs(queries, items, "q", "i", "v", 0.5, block=b).collect())) for b in (4096, 10)]
    assert pairs[0] == pairs[1]
    assert A.exact_top_k(queries.filter("false"), items, "q", "i", "v", 3).count() == 0 and A.exact_top_k(queries, items.filter("false"), "q", "i", "v", 3, block=10).count() == 0


def test_intervals_and_verdicts(spark):
    rows = spark.createDataFrame([(i, float(i % 4 == 0)) for i in range(400)], "k int, v double")
    got = B.iid_interval(rows, F.col("k").cast("string"), F.col("v"), 200, "s").first()
    assert got["observed"] == 0.25 and 0.19 < got["lower"] < 0.25 < got["upper"] < 0.31
    one = spark.createDataFrame([("a", 1, 0, 2), ("b", 0, 0, 0)], "c string, x int, y int, d int")
    assert tuple(B.paired_interval(one, "c", "x", "y", "d", 5, "s").first()) == (1, 0.5, None, None)
    good = dict(joint=0.4, flip=0.6, margin=0.8, joint_delta=0.12, joint_lower=0.01, joint_upper=0.2, flip_lower=0.01, flip_upper=0.2, margin_lower=0.0, macro_f1=0.5, accuracy=0.6, macro_f1_lower=0.0, accuracy_lower=0.0, calibrated=True, complete=True)

    def decide(provenance=True, **changes):
        seeds = spark.createDataFrame([{"seed": s, **good, **(changes if s == 0 else {})} for s in range(3)])
        return tuple(B.verdict(seeds, 0, provenance).select("failed", "verdict").first())

    assert decide() == ("", "GO")
    assert decide(joint_lower=-0.01) == ("G4", "INCONCLUSIVE")
    assert decide(joint_lower=-0.02, joint_upper=-0.01) == ("G4", "NO_GO")
    assert decide(accuracy=0.1, joint_lower=-0.01) == ("G4,G7", "NO_GO") and decide(provenance=False) == ("G10", "NO_GO")


def test_no_private_checkpoint_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
