"""Evidence groups: a group stands for the claim of the same number; its requirements are the lines of the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import digest, digest_of_sorted
from ..operators import claims as C
from ..operators import matching as M
from ..operators.shape import side_by_side
from . import fixtures as X
from .fixtures import P0, P1, with_parts
from .registry import query

Spark, Rows = SparkSession, DataFrame

_MASKS = "mk AS (SELECT group_id, text_hash, CAST(bit_or(1 << CAST(ordinal AS INT)) AS INT) AS mask FROM edge GROUP BY ALL), sz AS (SELECT group_id, count(*) r FROM req GROUP BY group_id HAVING count(*) <= 8)"
_HALL = (
    _MASKS
    + """, hl AS (SELECT sz.group_id, sub.subset, count(DISTINCT text_hash) AS neighbours, bit_count(CAST(sub.subset AS INT)) - count(DISTINCT text_hash) AS deficiency
 FROM sz CROSS JOIN (SELECT unnest(range(1, 256)) subset) sub LEFT JOIN mk ON mk.group_id = sz.group_id AND (mk.mask & CAST(sub.subset AS INT)) <> 0 WHERE sub.subset < (1 << CAST(sz.r AS INT)) GROUP BY sz.group_id, sub.subset),
 gs AS (SELECT group_id, r, r - greatest(0, max(deficiency)) AS matching_size, max(deficiency) <= 0 AS complete FROM hl JOIN sz USING (group_id) GROUP BY group_id, r)"""
)


@query(
    with_parts(
        "edge",
        "SELECT group_id, ordinal, text_hash, count(*) AS observations, string_agg(observation_id, ',' ORDER BY observation_id) AS observation_ids, min(observation_id) AS least_observation FROM edge GROUP BY ALL",
    )
)
def requirement_edges(spark: Spark, folder: str) -> Rows:
    return M.requirement_edges(X.edges(spark, folder))


@query(
    with_parts(
        "edge",
        """SELECT r.group_id, r.ordinal, coalesce(string_agg(DISTINCT text_hash, ',' ORDER BY text_hash), '') AS witness_hashes, count(DISTINCT text_hash) AS witness_count, count(text_hash) > 0 AS satisfied
 FROM req r LEFT JOIN edge e ON e.group_id = r.group_id AND e.ordinal = r.ordinal GROUP BY r.group_id, r.ordinal""",
    )
)
def requirement_state(spark: Spark, folder: str) -> Rows:
    return M.requirement_states(X.requirements(spark, folder), X.edges(spark, folder))


@query(with_parts("edge", _MASKS + " SELECT group_id, text_hash, mask FROM mk"))
def hash_masks(spark: Spark, folder: str) -> Rows:
    return M.hash_masks(X.edges(spark, folder))


@query(with_parts("edge", _HALL + " SELECT group_id, subset, neighbours, deficiency FROM hl"))
def hall_subsets(spark: Spark, folder: str) -> Rows:
    return M.hall_subsets(X.requirements(spark, folder), X.edges(spark, folder))


@query(with_parts("edge", _HALL + " SELECT group_id, r, matching_size, complete FROM gs"))
def group_state(spark: Spark, folder: str) -> Rows:
    return M.group_states(X.requirements(spark, folder), X.edges(spark, folder))


@query(with_parts("edge", _HALL + " SELECT group_id, matching_size FROM gs"))
def assignment_audit(spark: Spark, folder: str) -> Rows:
    """Matching sizes by exhaustive search over states; the SQL finds them by Hall's theorem."""
    return M.assignment_sizes(X.requirements(spark, folder), X.edges(spark, folder))


@query(with_parts("edge", "SELECT DISTINCT group_id, text_hash, dense_rank() OVER (PARTITION BY group_id ORDER BY text_hash) - 1 AS hash_ordinal FROM edge"))
def hash_ordinals(spark: Spark, folder: str) -> Rows:
    return M.hash_ordinals(X.edges(spark, folder))


@query(
    with_parts(
        "edge",
        _MASKS
        + """, c AS (SELECT sz.group_id, r, count(DISTINCT text_hash) hash_count, count(DISTINCT (ordinal, text_hash)) FILTER (text_hash IS NOT NULL) edge_count FROM sz LEFT JOIN edge USING (group_id) GROUP BY ALL),
 b AS (SELECT *, CAST(list_sum(list_transform(range(0, least(r, hash_count) + 1), lambda k: round(gamma(hash_count + 1.0) / (gamma(k + 1.0) * gamma(hash_count - k + 1.0))) * (r - k + 1))) AS BIGINT) state_bound FROM c)
 SELECT group_id, r, hash_count, edge_count, state_bound, hash_count > 16 OR edge_count > 128 OR state_bound > 100000 AS capped FROM b""",
    )
)
def assignment_preflight(spark: Spark, folder: str) -> Rows:
    return M.assignment_preflight(X.requirements(spark, folder), X.edges(spark, folder))


@query(with_parts("edge", _MASKS + " SELECT group_id, mask, text_hash FROM (SELECT mk.*, r, row_number() OVER (PARTITION BY group_id, mask ORDER BY text_hash) k FROM mk JOIN sz USING (group_id)) WHERE k <= r"))
def representative_hashes(spark: Spark, folder: str) -> Rows:
    return M.representatives(X.requirements(spark, folder), X.edges(spark, folder))


@query()
def group_certificate(spark: Spark, folder: str) -> Rows:
    """A perfect matching of every complete group; others of the same size would do as well, so no SQL fixes it."""
    return M.group_certificates(X.requirements(spark, folder), X.edges(spark, folder))


@query(with_parts("edge", _HALL + " SELECT count(*) FILTER (complete) AS certified, CAST(sum(r) FILTER (complete) AS BIGINT) AS certificate_rows, CAST(0 AS BIGINT) AS invalid FROM gs"))
def group_certificate_audit(spark: Spark, folder: str) -> Rows:
    requirements, edges = X.requirements(spark, folder), X.edges(spark, folder)
    rows = M.group_certificates(requirements, edges)
    counts = rows.agg(F.count_distinct("group_id").alias("certified"), F.count(F.lit(1)).alias("certificate_rows"))
    return side_by_side(counts, M.invalid_certificates(rows, requirements, edges).agg(F.count(F.lit(1)).alias("invalid")))


@query(
    with_parts(
        "edge dec1",
        """e1 AS (SELECT group_id, ordinal, text_hash, observation_id FROM dec1 d JOIN req ON group_id = d.claim_id AND req.line = d.line WHERE label = 'support'),
a AS (SELECT group_id, ordinal, text_hash, count(*) n FROM edge GROUP BY ALL), b AS (SELECT group_id, ordinal, text_hash, count(*) n FROM e1 GROUP BY ALL)
SELECT group_id, ordinal, text_hash, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM a FULL JOIN b USING (group_id, ordinal, text_hash) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
    )
)
def edge_refcount_changes(spark: Spark, folder: str) -> Rows:
    return _edge_changes(spark, folder)


def _edge_changes(spark: Spark, folder: str) -> Rows:
    from ..operators import deltas as D

    key = ["group_id", "ordinal", "text_hash"]
    flips = D.flips_by_partition(X.active_current(spark, folder), P0, P1).withColumnRenamed("claim_id", "group_id")
    flips = flips.join(X.requirements(spark, folder), ["group_id", "line"])
    signed = flips.select(*key, F.when(F.col("new_label") == "support", 1).when(F.col("old_label") == "support", -1).alias("delta")).dropna()
    return M.coalesce_edge_deltas(X.edges(spark, folder).groupBy(*key).agg(F.count(F.lit(1)).alias("n")), signed)


@query(
    with_parts(
        "edge dec1",
        """e1 AS (SELECT group_id, ordinal, text_hash FROM dec1 d JOIN req ON group_id = d.claim_id AND req.line = d.line WHERE label = 'support'),
a AS (SELECT group_id, text_hash, CAST(bit_or(1 << CAST(ordinal AS INT)) AS INT) m FROM edge GROUP BY ALL), b AS (SELECT group_id, text_hash, CAST(bit_or(1 << CAST(ordinal AS INT)) AS INT) m FROM e1 GROUP BY ALL)
SELECT group_id, text_hash, coalesce(a.m, 0) AS old_mask, coalesce(b.m, 0) AS new_mask FROM a FULL JOIN b USING (group_id, text_hash) WHERE coalesce(a.m, 0) <> coalesce(b.m, 0)""",
    )
)
def hash_mask_transitions(spark: Spark, folder: str) -> Rows:
    return M.mask_transitions(_edge_changes(spark, folder), X.edges(spark, folder))


def _combined(spark: Spark, folder: str) -> Rows:
    states = C.claim_states(X.claims(spark, folder), X.decisions(spark, folder, P0), ids=False)
    complete = M.group_states(X.requirements(spark, folder), X.edges(spark, folder)).filter("complete")
    return M.combined_claims(states, complete.select(F.col("group_id").alias("claim_id"), "group_id"))


_COMBINED = (
    _HALL
    + """, cb AS (SELECT claim_id, answer_id, required, support_count, refute_count, CASE WHEN complete THEN 1 ELSE 0 END AS complete_groups, CASE WHEN complete THEN CAST(claim_id AS VARCHAR) ELSE '' END AS group_ids,
 CASE WHEN (support_count > 0 OR coalesce(complete, false)) AND refute_count > 0 THEN 'conflicted' WHEN support_count > 0 OR coalesce(complete, false) THEN 'supported' WHEN refute_count > 0 THEN 'refuted' ELSE 'unsupported' END AS status
 FROM st0 LEFT JOIN gs ON group_id = claim_id)"""
)


@query(with_parts("st0 edge", _COMBINED + " SELECT claim_id, support_count, refute_count, complete_groups, group_ids, status FROM cb"))
def combined_claim_state(spark: Spark, folder: str) -> Rows:
    return _combined(spark, folder).select("claim_id", "support_count", "refute_count", "complete_groups", "group_ids", "status")


@query(with_parts("st0 edge", _COMBINED + ", " + X.answers_sql("ca", "cb") + " SELECT answer_id, required_count, supported_count, refuted_count, conflicted_count, unsupported_count, status FROM ca"))
def combined_answer_state(spark: Spark, folder: str) -> Rows:
    return C.answer_states(_combined(spark, folder))


@query(
    with_parts(
        "st0 edge",
        _HALL
        + """ SELECT claim_id, CASE WHEN support_least IS NOT NULL THEN 'direct' WHEN complete THEN 'group' ELSE 'none' END AS support_kind,
 coalesce(support_least, CASE WHEN complete THEN CAST(claim_id AS VARCHAR) END) AS support_ref, refute_least AS refute_id FROM st0 LEFT JOIN gs ON group_id = claim_id""",
    )
)
def combined_claim_certificate(spark: Spark, folder: str) -> Rows:
    complete = M.group_states(X.requirements(spark, folder), X.edges(spark, folder)).filter("complete")
    least = C.least_certificates(X.decisions(spark, folder, P0))
    return M.combined_certificates(X.claims(spark, folder), least, complete.select(F.col("group_id").alias("claim_id"), "group_id"))


@query(
    with_parts(
        "fx_chunk",
        """SELECT document_id, sha256(unhex(string_agg(printf('%016x', strlen(x)) || hex(encode(x)), '' ORDER BY x))) AS structure_digest FROM (SELECT DISTINCT document_id, text AS x FROM fx_chunk) GROUP BY document_id""",
    )
)
def structure_digest(spark: Spark, folder: str) -> Rows:
    """Order-free digest of the different texts of each document."""
    texts = X.chunks(spark, folder).groupBy("document_id").agg(F.collect_set("text").alias("texts"))
    return texts.select("document_id", digest_of_sorted(F.col("texts")).alias("structure_digest"))


@query(
    with_parts(
        "fx_chunk",
        """SELECT chunk_id, sha256(unhex(printf('%016x', strlen(document_id)) || hex(encode(document_id)) || printf('%016x', strlen(text)) || hex(encode(text)))) AS version_digest FROM fx_chunk""",
    )
)
def framed_digest(spark: Spark, folder: str) -> Rows:
    return X.chunks(spark, folder).select("chunk_id", digest(F.col("document_id"), F.col("text")).alias("version_digest"))
