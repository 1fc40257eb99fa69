"""Vector and lexical candidates, fusion and frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission as A
from ..operators.ranking import first_items
from ..session import table
from . import fixtures as X
from .fixtures import with_parts
from .registry import query

Spark, Rows = SparkSession, DataFrame


def _vectors(spark: Spark, folder: str, condition: str, key: str) -> Rows:
    return table(spark, folder, "embeddings").filter(condition).select(F.col("vec_id").alias(key), "embedding")


_DOT = "round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 12)"


def _top_sql(query_side: str, item_side: str, key: str, k: int, extra: str = "") -> str:
    return f"""SELECT {key}, item, rank FROM (SELECT {key}, item, row_number() OVER (PARTITION BY {key} ORDER BY x DESC, item) AS rank FROM (SELECT a.vec_id AS {key}, b.vec_id AS item, {_DOT} x
 FROM embeddings a JOIN embeddings b ON a.label {query_side} AND b.label {item_side}{extra})) WHERE rank <= {k}"""


@query(_top_sql("< 5", ">= 5", "claim_id", 5))
def vector_topk(spark: Spark, folder: str) -> Rows:
    claims, chunks = _vectors(spark, folder, "label < 5", "claim_id"), _vectors(spark, folder, "label >= 5", "chunk_id")
    return A.exact_top_k(claims, chunks, "claim_id", "chunk_id", "embedding", 5).drop("similarity")


@query(_top_sql(">= 5", "< 5", "chunk_id", 3))
def reverse_vector_topk(spark: Spark, folder: str) -> Rows:
    claims, chunks = _vectors(spark, folder, "label < 5", "claim_id"), _vectors(spark, folder, "label >= 5", "chunk_id")
    return A.exact_top_k(chunks, claims, "chunk_id", "claim_id", "embedding", 3).drop("similarity")


@query(_top_sql("< 5", "BETWEEN 5 AND 8", "claim_id", 4))
def fresh_frontier(spark: Spark, folder: str) -> Rows:
    """Retrieval for claims without the chunks of an excluded class."""
    claims, chunks = _vectors(spark, folder, "label < 5", "claim_id"), _vectors(spark, folder, "label >= 5", "chunk_id")
    excluded = _vectors(spark, folder, "label = 9", "chunk_id").select("chunk_id")
    return A.exact_top_k(claims, chunks.join(excluded, "chunk_id", "left_anti"), "claim_id", "chunk_id", "embedding", 4).drop("similarity")


@query(
    f"""WITH e AS ({_top_sql("< 5", ">= 5", "claim_id", 5)}), p AS (SELECT a.vec_id AS claim_id, b.vec_id AS item, {_DOT} x FROM embeddings a JOIN embeddings b ON a.label < 5 AND b.label >= 5 AND (a.embedding[1] >= 0) = (b.embedding[1] >= 0)),
f AS (SELECT claim_id, item FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY x DESC, item) r FROM p) WHERE r <= 5)
SELECT e.claim_id, count(*) AS expected, count(f.item) AS hit, count(f.item) / count(*) AS recall FROM e LEFT JOIN f USING (claim_id, item) GROUP BY e.claim_id"""
)
def ann_recall(spark: Spark, folder: str) -> Rows:
    """Recall of a search in one half-space against the exact one."""
    claims, chunks = _vectors(spark, folder, "label < 5", "claim_id"), _vectors(spark, folder, "label >= 5", "chunk_id")
    exact = A.exact_top_k(claims, chunks, "claim_id", "chunk_id", "embedding", 5)
    halves = [A.exact_top_k(claims.filter(h), chunks.filter(h), "claim_id", "chunk_id", "embedding", 5) for h in ("embedding[0] >= 0", "not embedding[0] >= 0")]
    return A.recall(exact, halves[0].unionByName(halves[1]), "claim_id")


@query(
    f"""SELECT a.vec_id AS claim_id, b.vec_id AS chunk_id, CASE WHEN {_DOT} >= 0.2 THEN 'support' ELSE 'neutral' END AS judgment FROM embeddings a JOIN embeddings b ON a.label < 5 AND b.label >= 5 AND b.vec_id % 20 = 0"""
)
def full_pair_audit(spark: Spark, folder: str) -> Rows:
    """Every registered claim against the chunks one event inserts, judged once each."""
    claims, chunks = _vectors(spark, folder, "label < 5", "claim_id"), _vectors(spark, folder, "label >= 5 and vec_id % 20 = 0", "chunk_id")
    rows = A.full_pairs(chunks, claims, "chunk_id", "claim_id", "embedding", -1.0)
    return rows.select(F.col("item").alias("claim_id"), "chunk_id", F.when(F.col("similarity") >= 0.2, "support").otherwise("neutral").alias("judgment"))


# lexical channel: claims are the claim texts, query chunks the evidence texts of the stated query set

_LEX = r"""c AS (SELECT example_id AS claim_id, max(claim) AS x FROM verification_example WHERE claim IS NOT NULL GROUP BY example_id), n AS (SELECT count(*) c FROM c),
ix AS (SELECT claim_id, lexeme, count(*) n FROM (SELECT claim_id, unnest(regexp_extract_all(lower(x), '[\p{L}\p{N}]+(?:[''-][\p{L}\p{N}]+)*')) lexeme FROM c) GROUP BY ALL),
fr AS (SELECT lexeme, count(*) df, ln((c + 1) / (count(*) + 1)) idf FROM ix, n GROUP BY lexeme, c)"""
_LEXQ = (
    _LEX
    + r""", q AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(lower(x), '[\p{L}\p{N}]+(?:[''-][\p{L}\p{N}]+)*')) lexeme FROM (SELECT example_id chunk_id, max(evidence) x FROM verification_example WHERE evidence IS NOT NULL AND CAST(right(example_id, 9) AS BIGINT) % 20 = 0 GROUP BY example_id)),
ql AS (SELECT chunk_id, lexeme, place FROM (SELECT chunk_id, q.lexeme, row_number() OVER (PARTITION BY chunk_id ORDER BY round(coalesce(idf, ln(c + 1)), 9) DESC, q.lexeme) place FROM q LEFT JOIN fr ON fr.lexeme = q.lexeme, n) WHERE place <= 32)"""
)


def _lexical(spark: Spark, folder: str) -> tuple[Rows, Rows, Rows]:
    """(index of the claims, their number, the different lexemes of the query chunks)."""
    rows = table(spark, folder, "verification_example")
    claims = rows.filter("claim is not null").groupBy(F.col("example_id").alias("claim_id")).agg(F.max("claim").alias("x"))
    stated = rows.filter((F.col("evidence").isNotNull()) & (F.substring("example_id", -9, 9).cast("bigint") % 20 == 0))
    chunks = stated.groupBy(F.col("example_id").alias("chunk_id")).agg(F.max("evidence").alias("x"))
    return A.lexeme_rows(claims, "claim_id", "x"), claims.agg(F.count(F.lit(1)).alias("c")), A.lexeme_rows(chunks, "chunk_id", "x").drop("n")


@query("WITH " + _LEX + " SELECT lexeme, df, round(idf, 9) AS idf FROM fr")
def lexical_idf(spark: Spark, folder: str) -> Rows:
    index, total, _ = _lexical(spark, folder)
    return A.document_frequency(index, total).withColumn("idf", F.round("idf", 9))


@query("WITH " + _LEXQ + " SELECT chunk_id, lexeme, place FROM ql")
def lexical_query(spark: Spark, folder: str) -> Rows:
    index, total, chunks = _lexical(spark, folder)
    return A.query_lexemes(chunks, "chunk_id", A.document_frequency(index, total), total)


def _lexical_sql(value: str) -> str:
    return f"""WITH {_LEXQ}, m AS (SELECT chunk_id, claim_id, {value} AS x FROM ql JOIN ix USING (lexeme) GROUP BY ALL)
SELECT chunk_id, claim_id, rank FROM (SELECT chunk_id, claim_id, row_number() OVER (PARTITION BY chunk_id ORDER BY round(x / (x + 1), 12) DESC, claim_id) AS rank FROM m) WHERE rank <= 8"""


def _lexical_topk(spark: Spark, folder: str, cover: bool) -> Rows:
    index, total, chunks = _lexical(spark, folder)
    queries = A.query_lexemes(chunks, "chunk_id", A.document_frequency(index, total), total)
    return A.lexical_search(queries, index, "chunk_id", "claim_id", 8, cover).drop("score")


@query(_lexical_sql("count(*)::DOUBLE"))
def lexical_overlap_topk(spark: Spark, folder: str) -> Rows:
    return _lexical_topk(spark, folder, cover=False)


@query(_lexical_sql("sum(n)::DOUBLE * 0.1"))
def lexical_cover_density_topk(spark: Spark, folder: str) -> Rows:
    return _lexical_topk(spark, folder, cover=True)


# channel hits

_HITS = """h AS (SELECT DISTINCT candidate_policy_id p, chunk_version_id c, claim_id i, channel, rank, CASE WHEN isnan(score) THEN NULL ELSE score END s, approximate_budget_per_inserted_chunk n, kind
 FROM impact_channel_hit JOIN controlled_policy ON policy_id = candidate_policy_id WHERE claim_id IS NOT NULL AND rank >= 1),
k AS (SELECT p, c, i, channel, n, kind, row_number() OVER (PARTITION BY p, c, channel ORDER BY rank, s DESC NULLS LAST, i) rk FROM (SELECT *, row_number() OVER (PARTITION BY p, c, channel, i ORDER BY rank, s DESC NULLS LAST) f FROM h) WHERE f = 1),
fu AS (SELECT p, c, i, fused_rank FROM (SELECT p, c, i, n, row_number() OVER (PARTITION BY p, c ORDER BY t, i) fused_rank FROM (SELECT p, c, i, n, min((rk, CASE channel WHEN 'vector' THEN 0 ELSE 1 END)) t FROM k WHERE channel IN ('vector', 'lexical') GROUP BY p, c, i, n)) WHERE fused_rank <= n)"""


def _hits(spark: Spark, folder: str) -> Rows:
    hits = table(spark, folder, "impact_channel_hit").select("candidate_policy_id", "chunk_version_id", "claim_id", "channel", "rank", "score")
    policy = table(spark, folder, "controlled_policy").select("policy_id", "kind", F.col("approximate_budget_per_inserted_chunk").alias("budget"))
    return hits.filter(F.col("rank") >= 1).dropna(subset=["claim_id"]).join(policy, hits["candidate_policy_id"] == policy["policy_id"])


_GROUP = ["candidate_policy_id", "chunk_version_id"]


def _fused(spark: Spark, folder: str) -> Rows:
    rows = _hits(spark, folder).filter(F.col("channel").isin("vector", "lexical"))
    ranked = first_items(rows, [*_GROUP, "channel"], [("rank", True), ("score", False)], "claim_id", "budget", "rank")
    policy = table(spark, folder, "controlled_policy").select(F.col("policy_id").alias("candidate_policy_id"), F.col("approximate_budget_per_inserted_chunk").alias("budget"))
    return A.fuse(ranked.join(policy, "candidate_policy_id"), _GROUP, "claim_id", {"vector": 0, "lexical": 1}, "budget")


@query("WITH " + _HITS + " SELECT p AS candidate_policy_id, c AS chunk_version_id, i AS claim_id, fused_rank FROM fu")
def fusion(spark: Spark, folder: str) -> Rows:
    return _fused(spark, folder)


@query(
    "WITH "
    + _HITS
    + """, l AS (SELECT DISTINCT p, c, i FROM h WHERE channel = 'lineage' AND kind LIKE 'union_lineage%')
SELECT p AS candidate_policy_id, c AS chunk_version_id, i AS claim_id, row_number() OVER (PARTITION BY p, c ORDER BY fused_rank NULLS LAST, i) AS fused_rank, m AS mandatory
 FROM (SELECT p, c, i, fused_rank, coalesce(m, false) AS m FROM fu FULL JOIN (SELECT *, true AS m FROM l) USING (p, c, i))"""
)
def fusion_with_lineage(spark: Spark, folder: str) -> Rows:
    lineage = _hits(spark, folder).filter("channel = 'lineage' and kind like 'union_lineage%'")
    return A.add_lineage(_fused(spark, folder), lineage, _GROUP, "claim_id")


@query(
    """SELECT epoch_id, candidate_policy_id, chunk_version_id, channel, count(*) AS n, count(DISTINCT rank) AS different FROM impact_channel_hit GROUP BY ALL
 HAVING NOT coalesce(min(rank) = 1 AND max(rank) = count(*) AND count(DISTINCT rank) = count(*), false)"""
)
def channel_rank_check(spark: Spark, folder: str) -> Rows:
    return A.bad_ranks(table(spark, folder, "impact_channel_hit"), ["epoch_id", "candidate_policy_id", "chunk_version_id", "channel"])


@query(
    """SELECT epoch_id, candidate_policy_id, chunk_version_id, claim_id, channel, count(*) AS variants FROM (SELECT DISTINCT epoch_id, candidate_policy_id, chunk_version_id, claim_id, channel, rank, channel_artifact_hash FROM impact_channel_hit) GROUP BY ALL HAVING count(*) > 1"""
)
def channel_hit_conflicts(spark: Spark, folder: str) -> Rows:
    return A.conflicts(table(spark, folder, "impact_channel_hit"), ["epoch_id", "candidate_policy_id", "chunk_version_id", "claim_id", "channel"], ["rank", "channel_artifact_hash"])


@query(
    """SELECT chunk_version_id, claim_id, min(channel_artifact_hash) AS owner, string_agg(DISTINCT channel, ',' ORDER BY channel) AS reasons FROM impact_channel_hit WHERE claim_id IS NOT NULL GROUP BY ALL"""
)
def pair_owner_dedup(spark: Spark, folder: str) -> Rows:
    hits = table(spark, folder, "impact_channel_hit").filter("claim_id is not null")
    return A.owners(hits, ["chunk_version_id", "claim_id"], "channel_artifact_hash", "channel")


@query(
    "WITH "
    + _HITS
    + """, o AS (SELECT p, c, i, n, kind, min(rk) r FROM k WHERE channel = 'vector' AND kind NOT IN ('lexical_only') OR channel = 'lexical' AND kind <> 'vector_only' GROUP BY ALL),
a AS (SELECT p, c, i FROM (SELECT *, row_number() OVER (PARTITION BY p, c ORDER BY r, i) j FROM o) WHERE j <= n UNION SELECT p, c, i FROM h WHERE channel = 'lineage' AND kind LIKE 'union_lineage%')
SELECT p AS candidate_policy_id, count(*) AS pairs, count(DISTINCT c) AS chunks FROM a GROUP BY p"""
)
def policy_variant_selection(spark: Spark, folder: str) -> Rows:
    """Pairs each policy admits from the channels its kind allows, plus lineage where it asks for it."""
    hits = _hits(spark, folder)
    allowed = ((F.col("channel") == "vector") & (F.col("kind") != "lexical_only")) | ((F.col("channel") == "lexical") & (F.col("kind") != "vector_only"))
    ranked = first_items(hits.filter(allowed), [*_GROUP, "channel"], [("rank", True), ("score", False)], "claim_id", "budget", "rank")
    policy = table(spark, folder, "controlled_policy").select(F.col("policy_id").alias("candidate_policy_id"), F.col("approximate_budget_per_inserted_chunk").alias("budget"))
    best = first_items(ranked.join(policy, "candidate_policy_id"), _GROUP, [("rank", True)], "claim_id", "budget")
    lineage = hits.filter("channel = 'lineage' and kind like 'union_lineage%'").select(*_GROUP, "claim_id")
    pairs = best.select(*_GROUP, "claim_id").unionByName(lineage).distinct()
    return pairs.groupBy("candidate_policy_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("chunk_version_id").alias("chunks"))


@query(
    """WITH e AS (SELECT claim_id k, chunk_version_id c, CASE WHEN isnan(score) THEN NULL ELSE score END s, rank FROM impact_channel_hit WHERE claim_id IS NOT NULL AND channel = 'frontier'),
v AS (SELECT DISTINCT claim_id k, chunk_version_id c FROM impact_channel_hit WHERE claim_id IS NOT NULL AND channel = 'lexical' AND rank = 1),
d AS (SELECT k, CAST(greatest(0, 5 - count(v.c)) AS INT) deficit FROM (SELECT k FROM e UNION SELECT k FROM v) x LEFT JOIN v USING (k) GROUP BY k),
r AS (SELECT k, c, row_number() OVER (PARTITION BY k ORDER BY max(s) DESC, min(rank) NULLS FIRST, c) j FROM e WHERE s >= 0.3 AND NOT EXISTS (SELECT 1 FROM v WHERE v.k = e.k AND v.c = e.c) GROUP BY k, c)
SELECT d.k AS claim_id, deficit, coalesce(string_agg(r.c, ',' ORDER BY j), '') AS refilled, count(r.c) < deficit AS fresh_needed FROM d LEFT JOIN r ON r.k = d.k AND j <= deficit WHERE deficit > 0 GROUP BY d.k, deficit"""
)
def frontier_refill(spark: Spark, folder: str) -> Rows:
    hits = table(spark, folder, "impact_channel_hit").filter("claim_id is not null")
    score = F.nanvl(F.col("score"), F.lit(None).cast("double"))
    entries = hits.filter("channel = 'frontier'").select("claim_id", "chunk_version_id", score.alias("score"), "rank")
    covered = hits.filter("channel = 'lexical' and rank = 1").select("claim_id", "chunk_version_id")
    return A.refill(entries, covered, "claim_id", "chunk_version_id", 5, 0.3)


@query(
    """WITH w AS (SELECT DISTINCT chunk_version_id FROM impact_channel_hit), a AS (SELECT chunk_version_id, count(*) n FROM staged_embedding WHERE model_artifact_id = 'emb-model-a3' GROUP BY ALL)
SELECT chunk_version_id, coalesce(n, 0) AS artifacts, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'complete' ELSE 'ambiguous' END AS state FROM w LEFT JOIN a USING (chunk_version_id)"""
)
def artifact_coverage(spark: Spark, folder: str) -> Rows:
    staged = table(spark, folder, "staged_embedding").filter("model_artifact_id = 'emb-model-a3'")
    return A.coverage(table(spark, folder, "impact_channel_hit"), staged, "chunk_version_id")


@query(
    with_parts(
        "fx_current fx_chunk",
        """SELECT DISTINCT o.claim_id, b.chunk_id FROM fx_current o JOIN fx_chunk a ON a.chunk_id = o.chunk_id AND NOT a.active JOIN fx_chunk b ON b.document_id = a.document_id AND b.text = a.text AND b.active""",
    )
)
def lineage_pairs(spark: Spark, folder: str) -> Rows:
    """Claims that cited a closed chunk, with the active chunks that carry on its text in the same document.

    An observation that is not current cites the same pair as the current one, so no latest is sought. A claim names each
    (document, text) once and nearly every chunk belongs to one of these, so its pairs are distinct as they are joined and pass no shuffle;
    only those of chunks with several rows of different document or text are made distinct.
    """
    chunks = X.chunks(spark, folder)
    closed = chunks.filter("not active").select("chunk_id", "document_id", "text").distinct()
    owned = chunks.filter("active and document_id is not null and text is not null").groupBy(F.col("chunk_id").alias("fresh"))
    owned = owned.agg(F.collect_set(F.struct("document_id", "text")).alias("places")).select("fresh", F.explode("places").alias("place"), (F.size("places") > 1).alias("several"))
    fresh = owned.select("place.*", "fresh", "several")
    cited = X.observations(spark, folder).select("claim_id", "chunk_id").join(closed, "chunk_id").select("claim_id", "document_id", "text").distinct()

    def pairs(several: bool) -> Rows:
        return cited.join(fresh.filter(F.col("several") == several), ["document_id", "text"]).select("claim_id", F.col("fresh").alias("chunk_id"))

    return pairs(False).unionByName(pairs(True).distinct())
