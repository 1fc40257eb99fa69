import random

import pytest

from attestra.llm import tokens as K

PARTS = ["a", "b", "the", "ing", "ä", "é", "日", "本", "x", "qu", "0", "23", "😀", "-", "=", "_", "​", "́", " ", "\n", "'s", "  ", "'t ", " \n\n", "\t", "<|endoftext|>"]


@pytest.fixture(scope="module")
def v():
    return K.vocabulary(K.VOCABULARY)


def by_library(texts):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(K.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def samples(n, seed=1):
    rng = random.Random(seed)
    for _ in range(n):
        pool = rng.sample(PARTS, rng.randint(1, 6))
        yield rng, "".join(rng.choices(pool, k=rng.randint(0, 120)))


def test_trees_give_the_exact_encoding(v):
    cases = [(text, rng.choice([4, 8, 13, 32]), rng.choice([3, 10, 40])) for rng, text in samples(1500)]
    for (text, leaf, size), want in zip(cases, by_library([c[0] for c in cases])):
        assert v.encode(text, leaf) == want
        out, stretch = [], []
        for data, alone, inside in v.blocks(text, size):
            if not inside:
                out += v.join_all(stretch)
                stretch = []
            stretch.append(v.stretch(data, leaf) if alone else v.encode(data.decode(), leaf))
        assert out + v.join_all(stretch) == want


def test_long_stretches(v):
    for unit in ("abcdefghij", "a", "日本", "=-", "7"):
        text = unit * 30000
        assert v.encode(text) == v.piece(text.encode())


def test_documents(spark, data, v):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r["doc_id"] for r in rows), by_library([r["text"] or "" for r in rows])))
    frame = spark.read.parquet(f"{data}/documents.parquet")
    for block in (K.BLOCK_BYTES, 200):
        assert {r["doc_id"]: r["ids"] for r in K.encode_texts(frame, "doc_id", "text", block=block).collect()} == want
    counted = K.count_tokens(frame.select("doc_id", "text"), "text")
    assert {r["doc_id"]: r["tokens"] for r in counted.collect()} == {k: len(i) for k, i in want.items()}


def test_awkward_rows(spark):
    kind = "doc_id bigint, text string, id string, ids string, seq int"
    rows = [(1, None, "", "", 0), (2, "", "", "", 0), (3, " ", "", "", 0), (None, "x y", "", "", 0), (4, "same", "", "", 0), (4, "same", "", "", 0), (5, "z" * 500 + " tail " + "q" * 700, "", "", 0), (5, "z" * 500, "", "", 0)]
    got = [(r["doc_id"], r["ids"]) for r in K.encode_texts(spark.createDataFrame(rows, kind), "doc_id", "text", leaf=64, block=128).collect()]
    want = list(zip((r[0] for r in rows), by_library([r[1] or "" for r in rows])))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert K.encode_texts(spark.createDataFrame([], kind), "doc_id", "text").count() == 0
    for length in ("seq", "n"):  # lengths that are wrong or null change nothing
        frame = spark.createDataFrame(rows, kind).selectExpr("*", "if(doc_id = 1 or doc_id = 4, 900, null) n")
        again = [(r["doc_id"], r["ids"]) for r in K.encode_texts(frame, "doc_id", "text", leaf=64, block=128, length=length).collect()]
        assert sorted(again, key=str) == sorted(want, key=str)
