import pytest

from attestra.llm.moderation import THRESHOLD
from attestra.llm.queries import queries
from attestra.llm.sql import oracle_sql
from compare import check_query

QUERIES, SQL = queries(), oracle_sql()
COLUMNS = {
    "p1_found": ["example_id_a", "example_id_b"], "p2_found": ["candidate_policy_id", "chunk_version_id", "claim_id"], "p3_found": ["document_version_id", "reason"], "p4_found": ["model_artifact_id", "chunk_version_id_a", "chunk_version_id_b"],
    "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(name, spark, duck, data):
    check_query(QUERIES[name], SQL[name], spark, duck, data)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_are_those_asked_for(name, spark, data):
    assert QUERIES[name](spark, data).columns == COLUMNS[name]


def test_overlap_views_agree(spark, data):
    """Pairs, links of records and the report are three views of the same overlaps."""
    rows = spark.read.parquet(f"{data}/verification_example.parquet").select("example_id", "split").collect()
    splits = {}
    for r in rows:
        splits.setdefault(r["example_id"], set()).add((r["split"] or "").strip().lower())
    pairs = {tuple(r) for r in QUERIES["p1_found"](spark, data).collect()}
    assert pairs and all(a < b and "train" in splits[a] | splits[b] and (splits[a] | splits[b]) - {"train"} for a, b in pairs)
    records = QUERIES["p1_overlap_by_record"](spark, data).collect()
    linked = {r["example_id"] for r in records if r["links"]}
    assert linked >= {i for pair in pairs for i in pair if splits[i].isdisjoint({"train"})}
    report = QUERIES["p1_overlap_report"](spark, data).collect()
    assert sum(r["training_links"] for r in report) == sum(r["links"] for r in records)
    assert sum(r["records"] for r in report) == len({(r["split"], r["source"], r["example_id"]) for r in records})


def test_pieces_put_together_are_the_texts(spark, data):
    from attestra.llm.chunking import canonical_text

    config = {r["artifact_id"]: r for r in spark.read.parquet(f"{data}/chunker_config.parquet").collect()}
    pieces = {}
    for r in QUERIES["p3_pieces"](spark, data).collect():
        pieces.setdefault(r["document_version_id"], {})[r["piece"]] = r
    for r in spark.read.parquet(f"{data}/document_version.parquet").collect():
        limits = config.get(r["chunker_artifact_id"])
        if r["raw_text"] is None or limits is None:
            continue
        text, mine = canonical_text(r["raw_text"]), [p for _, p in sorted(pieces[r["document_version_id"]].items())]
        assert all(len(p["text"]) <= limits["max_characters"] and text[p["start"] : p["end"]] == p["text"] for p in mine)
        assert mine[0]["start"] == 0 and mine[-1]["end"] == len(text)
        assert all(b["start"] == a["end"] - limits["overlap_characters"] for a, b in zip(mine, mine[1:]))


def test_mixes_and_scores_agree_with_their_summaries(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet").count()
    shares, mix = QUERIES["p7_shares"](spark, data).collect(), QUERIES["p7_mix"](spark, data).collect()
    assert len(shares) == spark.read.parquet(f"{data}/mixture_target.parquet").count() and 0 < len(mix) <= documents
    scores = {r["doc_id"]: r["score"] for r in QUERIES["p8_scores"](spark, data).collect()}
    found = {r["doc_id"] for r in QUERIES["p8_found"](spark, data).collect()}
    rates = QUERIES["p8_rates"](spark, data).collect()
    assert len(scores) == documents == sum(r["documents"] for r in rates)
    assert found == {k for k, v in scores.items() if v >= THRESHOLD} and len(found) == sum(r["toxic"] for r in rates)
    assert QUERIES["p6_ids"](spark, data).count() == documents


def test_every_usable_vector_has_its_full_list_of_neighbours(spark, duck, data):
    """The lists have no least similarity, only the pairs have one."""
    start = oracle_sql()["p4_found"].split("SELECT DISTINCT")[0]
    want = set(duck.execute(f"{start} SELECT m, ca, cb FROM t WHERE r <= claim_top_k").fetchall())
    low = duck.execute(f"{start} SELECT count(*) FROM t WHERE r <= claim_top_k AND x < min_similarity").fetchone()[0]
    got = {(r["model"], r["key"], r["other"]) for r in QUERIES["p4_neighbours"](spark, data).collect()}
    assert low > 0 and len(got) == len(want) and len(want & got) >= 0.9 * len(want)
