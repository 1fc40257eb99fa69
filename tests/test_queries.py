import pytest

from attestra.plans import all_queries, all_sql
from compare import check_query

QUERIES, SQL = all_queries(), all_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(name, spark, duck, data):
    check_query(QUERIES[name], SQL[name], spark, duck, data)


def test_queries_without_sql(spark, data):
    """The two that SQL does not fix are held against what any right result must fulfil."""
    assert set(QUERIES) - set(SQL) == {"group_certificate", "paragraph_chunks"}
    rows = [tuple(r) for r in QUERIES["group_certificate"](spark, data).select("group_id", "ordinal", "text_hash").collect()]
    assert len({(g, o) for g, o, _ in rows}) == len(rows) == len({(g, h) for g, _, h in rows})
    complete = {r["group_id"]: r["r"] for r in QUERIES["group_state"](spark, data).filter("complete").collect()}
    assert {g for g, *_ in rows} == set(complete) and len(rows) == sum(complete.values())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    chunks = {}
    for r in QUERIES["paragraph_chunks"](spark, data).orderBy("doc_id", "chunk_index").collect():
        assert 0 < len(r["chunk"]) <= 1200 and r["chunk_index"] == len(chunks.setdefault(r["doc_id"], []))
        chunks[r["doc_id"]].append(r["chunk"])
    for key, text in texts.items():
        assert "".join("".join(chunks.get(key, [])).split()) == "".join((text or "").split())


def test_entry(spark):
    import __spark_entry__ as entry

    rows = {r["status"]: r["answers"] for r in entry.entry(spark).collect()}
    assert sum(rows.values()) == 150
    assert set(entry.oracle_sql()) <= set(entry.queries())
