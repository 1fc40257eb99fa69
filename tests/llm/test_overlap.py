import random

import pytest

from attestra.llm import overlap as O

KIND = "example_id string, source string, split string, claim string, evidence string, cid string"


def found(spark, rows, **options):
    records = O.canonical_records(spark.createDataFrame(rows, KIND))
    members, links = O.cross_split_classes(records, **options)
    return {tuple(r) for r in O.overlap_pairs(members, links).collect()}


def brute(rows):
    kept = []
    for i, _, split, claim, evidence, *_ in rows:
        split = O.SPLITS.get((split or "").strip().lower())
        if i is not None and split and claim is not None and evidence is not None:
            a, b = O.elements(claim), O.elements(evidence)
            if a and b:
                kept.append((i, split, a, b))
    out = set()
    for i, s, a, b in kept:
        for j, t, c, d in kept:
            if s == "train" != t and i != j and O.shares_enough(a, c, 0.75) and O.shares_enough(b, d, 0.75):
                out.add((min(i, j), max(i, j)))
    return out


@pytest.mark.parametrize(
    "a, b",
    [
        ("The Cat sat", "the  CAT sat!"), ("ﬁne Ｃａｔ", "fine cat"), ("re­lease​", "release"), ("a &amp; b", "A, B"), ("<b>bold</b> move", "**bold** move"),
        ("one<br>two", "one two"), ("see [text](http://x.y)", "see text"), ("É", "é"), ("`code` _it_", "code it"), ("w<em>or</em>d", "word"),
    ],
)
def test_words_ignore_form(a, b):
    assert O.words(a) == O.words(b)


def test_repeats_are_counted():
    assert O.elements("a b a") == ["a", "a\t2", "b"]
    assert not O.shares_enough(O.elements("a a a a"), O.elements("a b c d"), 0.75)


@pytest.mark.parametrize("hot_rows", [256, 2])
def test_pairs_against_brute_force(spark, hot_rows):
    rng = random.Random(hot_rows)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [(rng.choices(vocabulary, k=rng.randint(4, 9)), rng.choices(vocabulary, k=rng.randint(8, 24))) for _ in range(12)]

    def vary(words):
        words = list(words)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rng.shuffle(words)
        return rng.choice([" ", "  ", ", "]).join(rng.choice([str.upper, str.title, str])(w) for w in words)

    rows = []
    for i in range(260):
        claim, evidence = rng.choice(base)[0], rng.choice(base)[1] if rng.random() < 0.3 else None
        if evidence is None:
            claim, evidence = rng.choice(base)
        split = rng.choice(["train", "TRAIN ", "dev", "test", "transfer\t", None, "other"])
        rows.append((f"e{i:03d}", rng.choice(["a", None]), split, rng.choice([vary(claim), None, " ", "!?"]) if i % 9 == 0 else vary(claim), vary(evidence), "clash"))
    rows += rows[:40]
    assert found(spark, rows, hot_rows=hot_rows) == brute(rows)


def test_copies_form_one_class(spark):
    rows = [(f"t{i}", "s", "train", "A b c d", "e f g h", "") for i in range(30)] + [("x", "s", "test", "a B c D!", "h g f e", ""), ("y", None, "dev", "a b c", "q r s t", "")]
    records = O.canonical_records(spark.createDataFrame(rows, KIND))
    members, links = O.cross_split_classes(records)
    assert links.count() == 1
    assert O.overlap_pairs(members, links).count() == 30
    got = {tuple(r) for r in O.overlap_report(members, links).collect()}
    assert got == {("test", "s", 1, 1, 30), ("development", None, 1, 0, 0)}


def test_empty_and_long(spark):
    assert found(spark, []) == set()
    long = " ".join(f"word{i}" for i in range(20000))
    rows = [("a", "s", "train", "c d e", long, ""), ("b", "s", "test", "c d e", long + " more", ""), ("c", "s", "test", "c d e", "word1 word2", "")]
    assert found(spark, rows) == {("a", "b")}
