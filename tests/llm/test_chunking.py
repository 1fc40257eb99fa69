import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestra.llm import chunking as K

TEXTS = st.text(alphabet=st.sampled_from("ab 1é日。.!?\n\r\t ́😀,-"), max_size=300)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 60), st.integers(0, 59))
def test_pieces_cover_the_text(raw, greatest, overlap):
    overlap = min(overlap, greatest - 1)
    text = K.canonical_text(raw)
    spans = K.pieces(text, greatest, overlap)
    assert all(b - a <= greatest for a, b in spans)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (_, end), (start, after) in zip(spans, spans[1:]):
        assert start == end - overlap and after > end
    assert text[: spans[0][1]] + "".join(text[a + overlap : b] for a, b in spans[1:]) == text
    assert (len(spans) > 1) == (len(text) > greatest)


def test_cuts_prefer_natural_boundaries():
    rng = random.Random(2)
    paragraphs = [" ".join(f"Sentence {rng.randrange(999)} has some plain words." for _ in range(rng.randint(1, 3))) for _ in range(60)]
    text = "\n\n".join(paragraphs)
    cuts = K.cut_positions(text, 400, 0)
    assert len(cuts) > 5 and all(text[c - 2 : c] == "\n\n" for c in cuts)
    one = " ".join(paragraphs)
    assert all(one[c - 2 : c] == ". " for c in K.cut_positions(one, 400, 40))
    words = one.replace(".", "")
    assert all(words[c - 1] == " " for c in K.cut_positions(words, 90, 10))


@pytest.mark.parametrize("overlap", [0, 100])
def test_a_word_that_fits_is_not_cut(overlap):
    text = "some words before " * 24 + "x" * 1100 + " and after" * 100  # its only blank in reach stands before the window
    cuts = K.cut_positions(text, 1200, overlap)
    assert cuts[0] == 18 * 24 and all(text[c - 1] != "x" or text[c] != "x" for c in cuts)
    at_limit = "x" * 50 + " " + "y" * 40
    assert K.cut_positions(at_limit, 50, 0) == [50]
    assert K.cut_positions("x" * 30 + "(" + "y" * 30, 40, 0) in ([30], [31])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 70), st.sampled_from([" ", ". ", "\n\n", "-", ", ", "(", "。", "\t"])), max_size=25), st.integers(1, 60), st.integers(0, 30))
def test_only_words_longer_than_a_piece_are_cut(parts, greatest, overlap):
    overlap = min(overlap, greatest - 1)
    text = K.canonical_text("".join("abcdé1"[n % 6] * n + gap for n, gap in parts))
    cuts = K.cut_positions(text, greatest, overlap)
    for m in re.finditer(r"[^\W_]+", text):
        if m.end() - m.start() <= greatest - overlap:
            assert not any(m.start() < c < m.end() for c in cuts)
    longest = max((m.end() - m.start() for m in re.finditer(r"[^\W_]+", text)), default=0)
    assert (K.longest_cut_run(text, cuts) > greatest) == (longest > greatest)


def test_an_edit_changes_only_neighbouring_pieces():
    rng = random.Random(7)
    text = " ".join(f"Word{rng.randrange(9999)} follows word{rng.randrange(9999)}." for _ in range(4000))
    edited = text[:5000] + " An inserted sentence. " + text[5000:]
    before = {text[a:b] for a, b in K.pieces(text, 800, 100)}
    after = [edited[a:b] for a, b in K.pieces(edited, 800, 100)]
    assert sum(p not in before for p in after) <= 8 < len(after) // 10


def test_marks_stay_with_their_letter():
    text = ("é" * 500).strip()
    assert all(text[c] != "́" for c in K.cut_positions(text, 100, 10))


KIND = "v string, t string, m int, o int, text string"


def test_rows(spark):
    rows = [
        ("none", None, 10, 2, ""), ("empty", "", 10, 2, ""), ("blank", " \n　", 10, 2, ""), ("short", " abc\r\n", 10, 2, ""), ("limit", "a" * 10, 10, 2, ""), ("run", "a" * 11, 10, 2, ""),
        ("words", "aaaa bbbb cccc", 10, 2, ""), ("no limit", "abc", None, 2, ""), ("zero", "abc", 0, 2, ""), ("wide", "ab cd ef", 3, 9, ""), ("null overlap", "ab cd ef", 4, None, ""), (None, "x", 5, 1, ""), ("twice", "ab cd ef gh", 6, 1, ""), ("twice", "ab cd ef gh", 6, 1, ""),
    ]
    got = defaultdict(list)
    for r in K.chunk_texts(spark.createDataFrame(rows, KIND), "v", "t", "m", "o").collect():
        got[r["v"]].append(r)
    assert {k for k in ("none", "no limit", "zero") if k in got} == set()
    assert [(r["text"], r["n_pieces"], r["over_limit"]) for k in ("empty", "blank", "short") for r in got[k]] == [("", 1, False), ("", 1, False), ("abc", 1, False)]
    assert not got["limit"][0]["over_limit"]
    assert all(r["over_limit"] and r["no_boundary"] for r in got["run"])
    assert all(r["over_limit"] and not r["no_boundary"] for r in got["words"])
    assert all(len(r["text"]) <= 3 for r in got["wide"]) and got[None][0]["text"] == "x"
    assert len(got["twice"]) % 2 == 0


def test_no_rows(spark):
    assert K.chunk_texts(spark.createDataFrame([], KIND), "v", "t", "m", "o").count() == 0


@pytest.mark.parametrize("size", [300_000])
def test_very_long_text(spark, size):
    text = "word " * (size // 5)
    rows = K.chunk_texts(spark.createDataFrame([("v", text, 1000, 100, "")], KIND), "v", "t", "m", "o")
    last = rows.orderBy("piece").collect()[-1]
    assert last["end"] == len(text.strip())
