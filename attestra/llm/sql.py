"""SQL for those queries of the training-data problems that SQL can express."""

from __future__ import annotations

_TEXT = "regexp_replace(regexp_replace(raw_text, '\\r\\n?', chr(10), 'g'), '^[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+$', '', 'g')"

_P2 = """WITH r AS (SELECT candidate_policy_id, chunk_version_id, claim_id, rank, CASE WHEN isnan(score) THEN NULL ELSE score END s, approximate_budget_per_inserted_chunk n
 FROM impact_channel_hit JOIN controlled_policy ON policy_id = candidate_policy_id WHERE claim_id IS NOT NULL AND rank >= 1 AND chunk_version_id IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY candidate_policy_id, chunk_version_id, claim_id ORDER BY rank, s DESC NULLS LAST) k FROM r),
g AS (SELECT *, row_number() OVER (PARTITION BY candidate_policy_id, chunk_version_id ORDER BY rank, s DESC NULLS LAST, claim_id) j FROM f WHERE k = 1)
SELECT candidate_policy_id, chunk_version_id, claim_id FROM g WHERE j <= n"""

_P3 = f"""WITH t AS (SELECT document_version_id, max_characters AS m, {_TEXT} AS x FROM document_version JOIN chunker_config ON artifact_id = chunker_artifact_id WHERE raw_text IS NOT NULL),
o AS (SELECT *, list_max(list_transform(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}]+'), lambda y: length(y))) AS run FROM t WHERE length(x) > m)
SELECT DISTINCT document_version_id, 'over_limit' AS reason FROM o UNION ALL SELECT DISTINCT document_version_id, 'no_boundary' FROM o WHERE run > m"""

_P4 = """WITH l AS (SELECT model_artifact_id m, chunk_version_id c, embedding e, row_number() OVER (PARTITION BY model_artifact_id, chunk_version_id ORDER BY staged_at DESC NULLS LAST) k FROM staged_embedding),
v AS (SELECT m, c, list_transform(e, lambda x: x::DOUBLE) e, claim_top_k, min_similarity FROM l, retrieval_config WHERE k = 1 AND len(e) = dimension AND list_bool_and(list_transform(e, lambda x: isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
s AS (SELECT a.m, a.c ca, b.c cb, list_cosine_similarity(a.e, b.e) x, a.claim_top_k, a.min_similarity FROM v a JOIN v b ON a.m = b.m AND a.c <> b.c),
t AS (SELECT *, row_number() OVER (PARTITION BY m, ca ORDER BY round(x, 12) DESC, cb) r FROM s)
SELECT DISTINCT m AS model_artifact_id, least(ca, cb) AS chunk_version_id_a, greatest(ca, cb) AS chunk_version_id_b FROM t WHERE r <= claim_top_k AND x >= min_similarity"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2, "p3_found": _P3, "p4_found": _P4}
