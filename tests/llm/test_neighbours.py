import numpy as np
import pytest

from attestra.llm import neighbours as K
from attestra.llm.forest import Forest

KIND = "c string, m string, e array<float>, t timestamp, model string"


def brute(rows, k, dimension, floor):
    best = {}
    for c, m, e, t, *_ in rows:
        if c is None or m is None:
            continue
        if (c, m) not in best or (t is not None, t or 0) > best[c, m][0]:
            best[c, m] = ((t is not None, t or 0), e)
    out = []
    for model in sorted({m for _, m in best}):
        names, x = [], []
        for (c, m), (_, e) in sorted(best.items()):
            if m == model and e is not None and len(e) == dimension and None not in e and np.isfinite(e).all() and any(e):
                names.append(c)
                x.append(e)
        x = np.array(x, np.float32).astype(np.float64).reshape(-1, dimension)
        x /= np.linalg.norm(x, axis=1)[:, None]
        s = np.round(x @ x.T, 9)
        for i, name in enumerate(names):
            order = sorted((j for j in range(len(names)) if j != i), key=lambda j: (-s[i, j], names[j]))
            out += [(model, name, n + 1, names[j]) for n, j in enumerate(order[:k]) if s[i, j] >= floor]
    return sorted(out)


def run(spark, rows, k=3, dimension=8, floor=0.7, **options):
    df = spark.createDataFrame(rows, KIND).repartition(3)
    got = K.most_similar(df, "c", "m", "e", "t", k, dimension, floor, **options)
    return sorted((r["model"], r["key"], r["place"], r["other"]) for r in got.collect())


def clustered(n, clusters, dimension, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dimension))
    return [(f"c{i:05d}", "A" if i % 3 else "B", (centres[rng.integers(clusters)] + 0.25 * rng.standard_normal(dimension)).astype(np.float32).tolist(), None, "") for i in range(n)]


def test_awkward_rows_exactly(spark):
    import datetime

    day = lambda d: datetime.datetime(2025, 1, d)
    e = lambda *x: [float(v) for v in x]
    rows = [
        ("a", "A", e(1, 0, 0), day(1), ""), ("a", "A", e(0, 1, 0), None, ""), ("b", "A", e(2, 0, 0), None, ""), ("b", "A", e(2, 0, 0), None, ""), ("c", "A", e(1, 0.1, 0), day(2), ""),
        ("d", "A", None, day(1), ""), ("e", "A", e(0, 0, 0), None, ""), ("f", "A", e(1, 2), None, ""), ("g", "A", e(float("nan"), 1, 1), None, ""), ("h", "B", e(1, 0, 0), None, ""),
        ("i", "A", e(1, 0, 0), day(1), ""), ("i", "A", None, day(2), ""), (None, "A", e(1, 0, 0), None, ""), ("j", None, e(1, 0, 0), None, ""), ("k", "A", e(0.5, 0, 0), None, ""), ("l", "A", e(0, 0, 1), None, ""),
    ]
    assert run(spark, rows, 2, 3) == brute(rows, 2, 3, 0.7)
    assert run(spark, rows, 2, 3, -1.0) == brute(rows, 2, 3, -1.0)
    assert run(spark, rows, 2, 3, broadcast_keys=0) == brute(rows, 2, 3, 0.7)
    assert run(spark, []) == []


def test_many_equal_vectors(spark):
    rows = [(f"x{i:04d}", "A", [1.0, 2.0, 0.0], None, "") for i in range(900)] + [(f"y{i:03d}", "A", [2.0 ** (i % 3), 2.0 ** (1 + i % 3), 0.0], None, "") for i in range(30)]
    assert run(spark, rows, 3, 3) == brute(rows, 3, 3, 0.7)


@pytest.mark.parametrize("floor", [0.7, -1.0])
def test_many_copies_of_other_lengths(spark, floor):
    """Copies scaled by no powers of two: their cosines in single precision differ by noise alone."""
    base = np.random.default_rng(3).standard_normal(8).astype(np.float32)
    rows = [(f"x{i * 37 % 600:03d}", "A", (base * np.float32((3, 5, 7)[i % 3] * (2 * i + 1))).tolist(), None, "") for i in range(600)]
    assert run(spark, rows, 3, 8, floor) == brute(rows, 3, 8, floor)


@pytest.mark.parametrize("floor", [0.7, -1.0])
def test_leaf_keeps_all_nearly_equal_directions(floor):
    rng = np.random.default_rng(4)
    base, others = rng.standard_normal(16), rng.standard_normal((300, 16))
    x = K._unit(np.concatenate([base * rng.uniform(1, 9, (40, 1)), others]).astype(np.float32))
    keys = [[f"k{i:03d}"] for i in rng.permutation(len(x))]
    s = np.round(x @ x.T, 12)
    want = [sorted((-s[i, j], keys[j][0]) for j in range(len(x)) if s[i, j] >= floor)[:5] for i in range(len(x))]
    assert [[k for _, k in row] for row in K.leaf_neighbours(x, keys, 5, floor)] == [[k for _, k in row] for row in want]


@pytest.mark.parametrize("seed", [0, 1])
def test_recall_with_many_leaves(spark, seed):
    rows = clustered(3000, 150, 32, seed)
    want = set(brute(rows, 4, 32, 0.7))
    got = set(run(spark, rows, 4, 32, leaf_rows=100, sample_rows=1500, trees=2, probes=2))
    pairs = lambda rows: {(m, min(a, b), max(a, b)) for m, a, _, b in rows}
    assert len(pairs(want) & pairs(got)) >= 0.9 * len(pairs(want))


def test_forest_puts_every_vector_into_one_leaf_of_each_tree():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 16)).astype(np.float32)
    forest = Forest(x[:500], 32, 3)
    leaves, trees = forest.search(x, 4)
    assert trees == 3 and leaves.shape == (2000, 7) and leaves.max() < forest.n_leaves
    assert all(len(set(row[row >= 0].tolist())) == (row >= 0).sum() for row in leaves)
    assert np.bincount(leaves[:, 0]).max() < 2000 * 3 / 32 * 2
    single, _ = Forest(x[:4], 8, 1).search(x[:10], 2)
    assert set(single[:, 0].tolist()) == {0} and (single[:, 1:] == -1).all()


def test_a_leaf_of_many_rows_is_split_again(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 16))
    x = K._unit(centres[rng.integers(60, size=6000)] + 0.3 * rng.standard_normal((6000, 16)))
    items = [[f"k{i:05d}"] for i in range(len(x))]
    want = list(K.leaf_neighbours(x, items, 6, 0.7))
    got = K.split_neighbours(x, items, 6, 0.7, 400, 2, 1)
    assert sum(len(set(a) & set(b)) for a, b in zip(want, got)) >= 0.95 * sum(map(len, want))
    assert all(near == sorted(near) and (0.7 <= -near[-1][0] if near else True) for near in got)
    assert K.split_neighbours(x[:3], [["a"], [], []], 6, -1.0, 1, 2, 1)[1][0][1] == "a"
    rows = clustered(3000, 40, 8)
    monkeypatch.setattr(K, "SPLIT_FROM", 0)
    want, got = brute(rows, 3, 8, 0.7), run(spark, rows, leaf_rows=200)
    assert len(set(want) & set(got)) >= 0.9 * len(want)


def test_pairs_that_deep_trees_part_are_found_through_common_neighbours(spark):
    rows = clustered(3000, 150, 32)
    pairs = lambda rows: {(m, min(a, b), max(a, b)) for m, a, _, b in rows}
    want, got = pairs(brute(rows, 4, 32, 0.7)), pairs(run(spark, rows, 4, 32, leaf_rows=12, sample_rows=1500, trees=2, probes=1))
    assert len(want & got) >= 0.99 * len(want)


def test_groups_follow_links_and_large_ones_are_cut(spark):
    links = spark.createDataFrame([(v, k) for v in range(10) for k in (v, min(v + 1, 9))] + [(20, 20), (20, 21), (21, 21), (21, 20), (30, 30), (30, 31)], "vid bigint, kid bigint")
    groups = {}
    for r in K.linked_groups(links, rounds=10).collect():
        groups.setdefault(r["group"], set()).add(r["vid"])
    assert sorted(map(sorted, groups.values())) == [list(range(10)), [20, 21]]
    cut = K.linked_groups(links, rounds=10, group_rows=4).collect()
    assert {r["vid"] for r in cut} == {*range(10), 20, 21} and len({r["group"] for r in cut}) > 2
