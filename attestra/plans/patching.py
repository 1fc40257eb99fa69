"""Patches and checks of stored relations, judged deltas, overlays of states, bootstraps and the verdict."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..operators import admission as A
from ..operators import claims as C
from ..operators import eventlog as E
from ..operators import matching as M
from ..operators import patches as P
from ..operators import records as R
from ..operators import resampling as B
from ..operators import temporal as T
from ..operators.ranking import first_items
from ..session import table
from . import fixtures as X
from .evaluation import _EV, _PR, _events, _predictions
from .fixtures import P0, P1, WITHDRAWN, with_parts
from .groups import _HALL
from .registry import query

Spark, Rows = SparkSession, DataFrame
_COLUMNS = ["support_count", "refute_count", "status"]

# point patches: the change from policy P0 to P1


def _states(spark: Spark, folder: str, policy: tuple[float, float]) -> Rows:
    return C.claim_states(X.claims(spark, folder), X.decisions(spark, folder, policy), ids=False).select("claim_id", *_COLUMNS)


def _patch(spark: Spark, folder: str) -> Rows:
    return P.prepare(_states(spark, folder, P0), _states(spark, folder, P1), "claim_id", _COLUMNS)


_DIFF = "pt AS (SELECT a.claim_id, a.support_count s0, a.refute_count r0, a.status t0, b.support_count s1, b.refute_count r1, b.status t1 FROM st0 a JOIN st1 b USING (claim_id) WHERE (a.support_count, a.refute_count, a.status) IS DISTINCT FROM (b.support_count, b.refute_count, b.status))"


@query(with_parts("st0 st1", _DIFF + " SELECT claim_id, s0 AS old_support, s1 AS new_support, t0 AS old_status, t1 AS new_status FROM pt"))
def point_patch(spark: Spark, folder: str) -> Rows:
    patch = _patch(spark, folder)
    return patch.select("claim_id", F.col("before.support_count").alias("old_support"), F.col("after.support_count").alias("new_support"), F.col("before.status").alias("old_status"), F.col("after.status").alias("new_status"))


@query(with_parts("st1", "SELECT claim_id, support_count, refute_count, status FROM st1"))
def patch_preview(spark: Spark, folder: str) -> Rows:
    """What readers would see after the patch, with nothing written."""
    return P.apply(_states(spark, folder, P0), _patch(spark, folder), "claim_id", _COLUMNS)


@query(with_parts("st0 st1", _DIFF + " SELECT claim_id, s0 AS expected_support, s0 + 1 AS found_support FROM pt WHERE claim_id % 5 = 0"))
def patch_conflicts(spark: Spark, folder: str) -> Rows:
    """Every fifth claim has moved since the patch was prepared."""
    moved = _states(spark, folder, P0).withColumn("support_count", F.col("support_count") + (F.col("claim_id") % 5 == 0).cast("int"))
    rows = P.conflicts(moved, _patch(spark, folder), "claim_id", _COLUMNS)
    return rows.select("claim_id", F.col("expected.support_count").alias("expected_support"), F.col("found.support_count").alias("found_support"))


@query(with_parts("st0 st1", _DIFF + " SELECT (SELECT count(*) FROM pt) AS patched, 0 AS left_over"))
def patch_rollback(spark: Spark, folder: str) -> Rows:
    """A patch applied and taken back leaves no difference."""
    base, patch = _states(spark, folder, P0), _patch(spark, folder)
    again = P.apply(P.apply(base, patch, "claim_id", _COLUMNS), P.inverse(patch, "claim_id"), "claim_id", _COLUMNS)
    left = C.differences(base, again, "claim_id", _COLUMNS).agg(F.count(F.lit(1)).alias("left_over"))
    return left.select(patch.agg(F.count(F.lit(1))).scalar().alias("patched"), "left_over")


# judged deltas and overlays: the withdrawn document


@query(
    with_parts(
        "stw st0 anw an0",
        """SELECT 'claim' AS object_kind, claim_id AS object_id, a.status AS old_status, b.status AS new_status FROM stw a JOIN st0 b USING (claim_id) WHERE a.status <> b.status
UNION ALL SELECT 'answer', answer_id, a.status, b.status FROM anw a FULL JOIN an0 b USING (answer_id) WHERE a.status IS DISTINCT FROM b.status""",
    )
)
def exhaustive_additive_delta(spark: Spark, folder: str) -> Rows:
    """Status changes that an exhaustive audit of one document makes: the surviving judgments and the audited ones, which must not share a
    pair, are put together, only touched claims and answers are computed again, and the states are compared."""
    rows = X.decisions(spark, folder, P0).select("claim_id", "chunk_id", "label", "document_id")
    surviving, audited = rows.filter(F.col("document_id") != WITHDRAWN), rows.filter(F.col("document_id") == WITHDRAWN)
    claims = X.claims(spark, folder)
    touched = claims.join(audited.select("claim_id").distinct(), "claim_id", "left_semi")
    both = surviving.unionByName(audited).join(touched.select("claim_id"), "claim_id", "left_semi")
    pairs = both.groupBy("claim_id", "chunk_id").agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("n"))
    disjoint = F.when(F.col("n") > 1, F.raise_error(F.lit("a pair is audited and survives")).cast("boolean")).otherwise(F.lit(True))
    before, after = C.claim_statuses(claims, surviving), C.claim_statuses(touched, pairs.filter(disjoint))
    moved = C.status_deltas(before.join(touched.select("claim_id"), "claim_id", "left_semi"), after, "claim_id", "claim")
    answers = claims.join(moved.select(F.col("object_id").alias("claim_id")), "claim_id", "left_semi").filter("required").select("answer_id").distinct()
    now = T.overlay(before, after, ["claim_id"], F.lit(False)).join(answers, "answer_id", "left_semi")
    old = before.join(answers, "answer_id", "left_semi")
    return moved.unionByName(C.status_deltas(C.answer_states(old), C.answer_states(now), "answer_id", "answer"))


_FAULTS = """j AS (SELECT l_orderkey AS claim_id, l_partkey % 40 AS chunk_id FROM lineitem), f AS (SELECT claim_id, chunk_id, 'duplicate_pair' AS reason FROM j GROUP BY ALL HAVING count(*) > 1
 UNION SELECT claim_id, chunk_id, 'unknown_claim' FROM j WHERE claim_id % 13 = 0 UNION SELECT claim_id, chunk_id, 'unknown_chunk' FROM j WHERE chunk_id >= 37)"""


@query(f"WITH {_FAULTS} SELECT reason, count(*) AS pairs FROM f GROUP BY reason")
def judgment_validation(spark: Spark, folder: str) -> Rows:
    """Judgments that no recompute may use, against registries that lack every thirteenth claim and the last chunks."""
    judgments = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_partkey") % 40).alias("chunk_id"))
    claims = table(spark, folder, "orders").select(F.col("o_orderkey").alias("claim_id")).filter("claim_id % 13 <> 0")
    return P.judgment_faults(judgments, claims, spark.range(37).toDF("chunk_id")).groupBy("reason").agg(F.count(F.lit(1)).alias("pairs"))


@query(with_parts("st0", "SELECT claim_id, status FROM st0"))
def independent_recompute(spark: Spark, folder: str) -> Rows:
    """Claim statuses from pair judgments by flags alone, without the counts of the other plans."""
    flags = X.decisions(spark, folder, P0).groupBy("claim_id").agg(F.bool_or(F.col("label") == "support").alias("s"), F.bool_or(F.col("label") == "refute").alias("r"))
    rows = X.claims(spark, folder).select("claim_id").join(flags, "claim_id", "left").na.fill(False, ["s", "r"])
    both = F.when(F.col("s") & F.col("r"), "conflicted").when(F.col("s"), "supported").when(F.col("r"), "refuted").otherwise("unsupported")
    return rows.select("claim_id", both.alias("status"))


def _suffixed(sql: str, names: str, suffix: str) -> str:
    return re.sub(rf"\b({names})\b", rf"\1{suffix}", sql)


_EDGEW = "edgew AS (SELECT group_id, ordinal, text_hash, observation_id FROM decw d JOIN req ON group_id = d.claim_id AND req.line = d.line WHERE label = 'support')"
_HALLW = _suffixed(_HALL, "edge|mk|sz|hl|gs", "w")


def _combined_sql(name: str, states: str, groups: str) -> str:
    return f"""{name} AS (SELECT claim_id, answer_id, required, CASE WHEN (support_count > 0 OR coalesce(complete, false)) AND refute_count > 0 THEN 'conflicted' WHEN support_count > 0 OR coalesce(complete, false) THEN 'supported'
 WHEN refute_count > 0 THEN 'refuted' ELSE 'unsupported' END AS status FROM {states} LEFT JOIN {groups} ON group_id = claim_id)"""


@query(
    with_parts(
        "st0 stw edge decw",
        f"""{_EDGEW}, {_HALL}, {_HALLW}, {_combined_sql("cm", "st0", "gs")}, {_combined_sql("cw", "stw", "gsw")}, {X.answers_sql("am", "cm")}, {X.answers_sql("aw", "cw")}
SELECT 'claim' AS object_kind, claim_id AS object_id, a.status AS old_status, b.status AS new_status FROM cm a JOIN cw b USING (claim_id) WHERE a.status <> b.status
UNION ALL SELECT 'answer', answer_id, a.status, b.status FROM am a FULL JOIN aw b USING (answer_id) WHERE a.status IS DISTINCT FROM b.status""",
    )
)
def combined_status_deltas(spark: Spark, folder: str) -> Rows:
    """Changes of the public statuses, which count direct evidence and complete groups, when a document is withdrawn."""
    requirements, claims = X.requirements(spark, folder), X.claims(spark, folder)

    def states(keep: str | None) -> Rows:
        rows = X.decisions(spark, folder, P0, keep)
        edges = rows.filter("label = 'support'").select(F.col("claim_id").alias("group_id"), "line", "text_hash", "observation_id").join(requirements, ["group_id", "line"]).drop("line")
        complete = M.group_states(requirements, edges).filter("complete").select(F.col("group_id").alias("claim_id"), "group_id")
        return M.combined_claims(C.claim_states(claims, rows, ids=False), complete)

    before, after = states(None), states(f"document_id <> '{WITHDRAWN}'")
    deltas = C.status_deltas(before, after, "claim_id", "claim")
    return deltas.unionByName(C.status_deltas(C.answer_states(before), C.answer_states(after), "answer_id", "answer"))


@query(
    with_parts(
        "edge decw",
        f"""{_EDGEW}, tg AS (SELECT DISTINCT claim_id g FROM dec0 WHERE document_id = '{WITHDRAWN}'), q0 AS (SELECT r.group_id, r.ordinal, count(DISTINCT text_hash) n FROM req r LEFT JOIN edge e ON e.group_id = r.group_id AND e.ordinal = r.ordinal GROUP BY ALL),
q1 AS (SELECT r.group_id, r.ordinal, count(DISTINCT text_hash) n FROM req r LEFT JOIN edgew e ON e.group_id = r.group_id AND e.ordinal = r.ordinal GROUP BY ALL)
SELECT group_id, ordinal, n AS witness_count, n > 0 AS satisfied FROM q0 WHERE group_id NOT IN (SELECT g FROM tg) UNION ALL SELECT group_id, ordinal, n, n > 0 FROM q1 WHERE group_id IN (SELECT g FROM tg) AND group_id % 11 <> 0""",
    )
)
def effective_requirement_states(spark: Spark, folder: str) -> Rows:
    """Published requirement states under the working ones of the touched groups; every eleventh of those is retired by a tombstone."""
    requirements = X.requirements(spark, folder)
    rows = X.decisions(spark, folder, P0)

    def states(rows: Rows, wanted: Rows) -> Rows:
        edges = rows.filter("label = 'support'").select(F.col("claim_id").alias("group_id"), "line", "text_hash").join(requirements, ["group_id", "line"])
        counts = edges.groupBy("group_id", "ordinal").agg(F.count_distinct("text_hash").alias("witness_count"))
        out = wanted.select("group_id", "ordinal").join(counts, ["group_id", "ordinal"], "left").na.fill(0, ["witness_count"])
        return out.withColumn("satisfied", F.col("witness_count") > 0)

    touched = rows.filter(F.col("document_id") == WITHDRAWN).select(F.col("claim_id").alias("group_id")).distinct()
    mine = rows.filter(F.col("document_id") != WITHDRAWN).join(touched.withColumnRenamed("group_id", "claim_id"), "claim_id", "left_semi")
    working = states(mine, requirements.join(touched, "group_id", "left_semi"))
    return T.overlay(states(rows, requirements), working, ["group_id", "ordinal"], F.col("group_id") % 11 == 0)


# stored relations


@query("SELECT count(*) AS open_epochs FROM (SELECT DISTINCT epoch_id FROM m4_update WHERE epoch_id IS NOT NULL AND epoch_id NOT IN (SELECT previous_published_epoch_id FROM m4_update WHERE previous_published_epoch_id IS NOT NULL))")
def open_epoch_check(spark: Spark, folder: str) -> Rows:
    """Epochs that no other epoch follows; a clean history has one at most."""
    rows = table(spark, folder, "m4_update")
    epochs = rows.select("epoch_id").dropna().distinct()
    return epochs.join(rows.select(F.col("previous_published_epoch_id").alias("epoch_id")).dropna().distinct(), "epoch_id", "left_anti").agg(F.count(F.lit(1)).alias("open_epochs"))


@query(
    """WITH r AS (SELECT l_orderkey // 2 AS group_id, l_linenumber - 1 AS ordinal FROM lineitem WHERE l_quantity > 8), c AS (SELECT group_id, count(*) members, min(ordinal) lo, max(ordinal) hi, count(DISTINCT ordinal) d FROM r GROUP BY 1)
SELECT group_id, members, CASE WHEN members > 8 THEN 'size' ELSE 'gap' END AS reason FROM c WHERE members > 8 OR NOT (lo = 0 AND hi = members - 1 AND d = members)"""
)
def group_integrity_check(spark: Spark, folder: str) -> Rows:
    rows = table(spark, folder, "lineitem").filter("l_quantity > 8").select(F.floor(F.col("l_orderkey") / 2).alias("group_id"), (F.col("l_linenumber") - 1).alias("ordinal"))
    return P.bad_ordinals(rows, "group_id", "ordinal")


_JOBS = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'leased' WHEN 'error' THEN 'retryable' WHEN 'signup' THEN 'completed' ELSE 'failed' END"


@query(
    f"""WITH s AS (SELECT user_id, {_JOBS} AS new, lag({_JOBS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events)
SELECT old, new, count(*) AS changes FROM s WHERE old IS NOT NULL AND NOT (old = 'pending' AND new = 'leased' OR old = 'leased' AND new IN ('completed', 'retryable', 'failed') OR old = 'retryable' AND new IN ('leased', 'failed')) GROUP BY ALL"""
)
def job_transition_check(spark: Spark, folder: str) -> Rows:
    """Changes of job states that the state machine does not allow; a job's states are a user's events in time."""
    states = F.expr(_JOBS)
    rows = table(spark, folder, "events").withColumn("new", states)
    rows = rows.withColumn("old", F.lag("new").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).filter("old is not null")
    return E.bad_transitions(rows, "old", "new").groupBy("old", "new").agg(F.count(F.lit(1)).alias("changes"))


@query("SELECT o_orderkey AS id, coalesce(n, 0) AS recounted, CAST(o_orderkey % 5 AS BIGINT) AS stored FROM orders LEFT JOIN (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(n, 0) <> o_orderkey % 5")
def runtime_counter_check(spark: Spark, folder: str) -> Rows:
    stored = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).alias("n"))
    recounted = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return P.wrong_counters(stored, recounted, "id", "n")


_OLD = "SELECT document_version_id, content_hash, valid_to_epoch FROM document_version"


@query(f"WITH o AS ({_OLD}), n AS (SELECT document_version_id, content_hash, CASE WHEN valid_to_epoch % 7 = 0 THEN NULL ELSE valid_to_epoch END FROM document_version) SELECT document_version_id, count(*) AS lost FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) GROUP BY 1")
def append_only_check(spark: Spark, folder: str) -> Rows:
    """Rows that a new version of an append-only table has changed: here the closing epochs that are divisible by seven."""
    old = table(spark, folder, "document_version").select("document_version_id", "content_hash", "valid_to_epoch")
    new = old.withColumn("valid_to_epoch", F.when(F.col("valid_to_epoch") % 7 != 0, F.col("valid_to_epoch")))
    return P.not_append_only(old, new).groupBy("document_version_id").agg(F.count(F.lit(1)).alias("lost"))


_LABELS = {"support": "support", "supported": "support", "contradict": "refute", "contradicts": "refute", "refute": "refute", "partially_supported": "neutral", "not_supported": "neutral", "neutral": "neutral"}


@query("SELECT CASE lower(trim(label)) WHEN 'support' THEN 'support' WHEN 'refute' THEN 'refute' WHEN 'neutral' THEN 'neutral' END AS mapped, count(*) AS n FROM verification_example GROUP BY 1")
def label_map(spark: Spark, folder: str) -> Rows:
    """Labels of the sources mapped to those of the engine; unknown ones are null, to be rejected."""
    return table(spark, folder, "verification_example").groupBy(P.label_of("label", _LABELS).alias("mapped")).agg(F.count(F.lit(1)).alias("n"))


# admission by scope


@query(
    """WITH h AS (SELECT DISTINCT epoch_id e, candidate_policy_id p, sha256(chunk_version_id || chr(0) || claim_id) d, channel, rank, CASE WHEN isnan(score) THEN NULL ELSE score END s, approximate_budget_per_inserted_chunk n, kind FROM impact_channel_hit JOIN controlled_policy ON policy_id = candidate_policy_id WHERE claim_id IS NOT NULL AND rank >= 1),
k AS (SELECT *, row_number() OVER (PARTITION BY e, p, channel ORDER BY rank, s DESC NULLS LAST, d) rk FROM (SELECT *, row_number() OVER (PARTITION BY e, p, channel, d ORDER BY rank, s DESC NULLS LAST) f FROM h) WHERE f = 1),
fu AS (SELECT * FROM (SELECT e, p, d, n, row_number() OVER (PARTITION BY e, p ORDER BY t, d) fr FROM (SELECT e, p, d, n, min((rk, CASE channel WHEN 'vector' THEN 0 ELSE 1 END)) t FROM k WHERE channel IN ('vector', 'lexical') GROUP BY ALL)) WHERE fr <= n),
l AS (SELECT DISTINCT e, p, d FROM h WHERE channel = 'lineage' AND kind LIKE 'union_lineage%'), a AS (SELECT e, p, d, row_number() OVER (PARTITION BY e, p ORDER BY fr NULLS LAST, d) fr FROM fu FULL JOIN l USING (e, p, d))
SELECT e AS epoch_id, p AS candidate_policy_id, d AS pair_digest, fr AS fused_rank, (SELECT string_agg(DISTINCT channel, ',' ORDER BY channel) FROM h WHERE h.e = a.e AND h.p = a.p AND h.d = a.d) AS reasons FROM a"""
)
def scope_fusion(spark: Spark, folder: str) -> Rows:
    """Vector and lexical pairs of a root and scope in turn, vector first, then the pairs that only lineage names in the order of their digest."""
    scope = ["epoch_id", "candidate_policy_id"]
    hits = table(spark, folder, "impact_channel_hit").filter("rank >= 1 and claim_id is not null and epoch_id is not null and chunk_version_id is not null")
    policy = table(spark, folder, "controlled_policy").select(F.col("policy_id").alias("candidate_policy_id"), "kind", F.col("approximate_budget_per_inserted_chunk").alias("budget"))
    digest = F.sha2(F.concat_ws("\u0000", "chunk_version_id", "claim_id"), 256)
    rows = hits.select(*scope, digest.alias("pair_digest"), "channel", "rank", "score").join(policy, "candidate_policy_id")
    ranked = first_items(rows.filter("channel in ('vector', 'lexical')"), [*scope, "channel"], [("rank", True), ("score", False)], "pair_digest", "budget", "rank")
    fused = A.fuse(ranked.join(policy, "candidate_policy_id"), scope, "pair_digest", {"vector": 0, "lexical": 1}, "budget")
    all_ = A.add_lineage(fused, rows.filter("channel = 'lineage' and kind like 'union_lineage%'"), scope, "pair_digest").drop("mandatory")
    reasons = rows.groupBy(*scope, "pair_digest").agg(F.array_join(F.sort_array(F.collect_set("channel")), ",").alias("reasons"))
    return all_.join(reasons, [*scope, "pair_digest"])


@query("SELECT claim_id AS root, min(why) AS first_reason FROM (SELECT claim_id, 'new' why FROM impact_channel_hit WHERE channel = 'lexical' AND claim_id IS NOT NULL UNION ALL SELECT claim_id, 'refill' FROM impact_channel_hit WHERE channel = 'frontier' AND claim_id IS NOT NULL) GROUP BY 1")
def root_key_coalesce(spark: Spark, folder: str) -> Rows:
    """Keys that are new and keys that fall back, each once."""
    hits = table(spark, folder, "impact_channel_hit").filter("claim_id is not null and channel in ('lexical', 'frontier')")
    why = F.when(F.col("channel") == "lexical", "new").otherwise("refill")
    return hits.groupBy(F.col("claim_id").alias("root")).agg(F.min(why).alias("first_reason"))


# evaluation


def _poisson_sql(u: str) -> str:
    return "(" + " + ".join(f"({u} >= {bound})::INT" for bound in B.POISSON) + ")"


def _draw_sql(seed: str, rep: str, key: str, modulus: str) -> str:
    return f"CAST(('0x' || substr(sha256('{seed}' || chr(0) || CAST({rep} AS VARCHAR) || chr(0) || {key}), 1, 16))::UBIGINT % {modulus} AS BIGINT)"


_ROUND = ("observed", "lower", "upper")


def _rounded(rows: Rows) -> Rows:
    return rows.withColumns({c: F.round(c, 9) for c in _ROUND})


@query(
    f"""WITH {_PR}, w AS (SELECT rep, truth = pred AS ok, {_poisson_sql("u")} AS w FROM (SELECT truth, pred, rep, {_draw_sql("i1", "rep", "CAST(cs AS VARCHAR) || '-' || CAST(line AS VARCHAR)", "4294967296")} u FROM pr, (SELECT unnest(range(0, 12)) rep))),
v AS (SELECT rep, sum(w * ok::INT) / sum(w) AS value FROM w GROUP BY rep) SELECT round((SELECT avg(ok::INT) FROM (SELECT truth = pred ok FROM pr)), 9) AS observed, round(quantile_cont(value, 0.025), 9) AS lower, round(quantile_cont(value, 0.975), 9) AS upper FROM v"""
)
def iid_bootstrap_interval(spark: Spark, folder: str) -> Rows:
    key = F.concat_ws("-", "cs", "line")
    return _rounded(B.iid_interval(_predictions(spark, folder), key, (F.col("truth") == F.col("pred")).cast("int"), 12, "i1"))


@query(
    f"""WITH {_EV}, c AS (SELECT cluster, sum(num)::BIGINT num, sum(den)::BIGINT den, row_number() OVER (ORDER BY cluster) - 1 i FROM ev GROUP BY cluster), k AS (SELECT count(*) n FROM c),
d AS (SELECT rep, {_draw_sql("s2", "rep", "CAST(c.i AS VARCHAR)", "n")} j FROM c, k, (SELECT unnest(range(0, 40)) rep)), v AS (SELECT rep, sum(num) / nullif(sum(den), 0) value FROM d JOIN c ON c.i = d.j GROUP BY rep)
SELECT (SELECT round(sum(num) / sum(den), 9) FROM c) AS observed, round(quantile_cont(value, 0.025), 9) AS lower, round(quantile_cont(value, 0.975), 9) AS upper FROM v"""
)
def cluster_bootstrap_interval(spark: Spark, folder: str) -> Rows:
    sums = _events(spark, folder).groupBy("cluster").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    return _rounded(B.cluster_interval(sums, "cluster", "num", "den", 40, "s2"))


@query(
    f"""WITH {_PR}, b AS (SELECT cluster, count(*) FILTER (truth = pred) a1, count(*) FILTER (truth = pred AND conf >= 0.5) a2, count(*) den FROM pr GROUP BY 1), c AS (SELECT (a1 - a2) / den x, row_number() OVER (ORDER BY cluster) - 1 i FROM b), k AS (SELECT count(*) n FROM c),
d AS (SELECT rep, {_draw_sql("s3", "rep", "CAST(c.i AS VARCHAR)", "n")} j FROM c, k, (SELECT unnest(range(0, 40)) rep)), v AS (SELECT rep, avg(x) value FROM d JOIN c ON c.i = d.j GROUP BY rep)
SELECT (SELECT count(*) FROM c) AS clusters, (SELECT round(avg(x), 9) FROM c) AS observed, round(quantile_cont(value, 0.025), 9) AS lower, round(quantile_cont(value, 0.975), 9) AS upper FROM v"""
)
def paired_cluster_bootstrap(spark: Spark, folder: str) -> Rows:
    """The accuracy of a policy that answers always, less that of one that answers with confidence only."""
    right = F.col("truth") == F.col("pred")
    rows = _predictions(spark, folder).groupBy("cluster").agg(F.count_if(right).alias("a1"), F.count_if(right & (F.col("conf") >= 0.5)).alias("a2"), F.count(F.lit(1)).alias("den"))
    return _rounded(B.paired_interval(rows, "cluster", "a1", "a2", "den", 40, "s3"))


_SEEDS = """s AS (SELECT user_id % 3 AS seed, avg(value) / 100 joint, avg(value) / 80 flip, avg(value) / 55 margin, 0.12 joint_delta, avg(value) / 1000 - 0.06 joint_lower, avg(value) / 1000 joint_upper, avg(value) / 1000 - 0.04 flip_lower, avg(value) / 1000 flip_upper, -0.01 margin_lower, 0.5 macro_f1, 0.6 accuracy, -0.02 macro_f1_lower, -0.01 accuracy_lower, count(*) > 0 calibrated, count(*) > 10 complete FROM events GROUP BY 1)"""


@query(
    f"""WITH {_SEEDS}, p AS (SELECT *, (SELECT count(*) FROM s WHERE joint >= 0.3 AND flip >= 0.5 AND margin >= 0.75) AS passing FROM s WHERE seed = 0), c AS (SELECT passing, joint_lower > 0 AS g4, flip_lower > 0 AS g5, joint >= 0.3 AND flip >= 0.5 AND margin >= 0.75 AND passing >= 2 AS base,
 concat_ws(',', CASE WHEN NOT (joint >= 0.3 AND passing >= 2) THEN 'G1' END, CASE WHEN NOT (flip >= 0.5 AND passing >= 2) THEN 'G2' END, CASE WHEN NOT (margin >= 0.75 AND passing >= 2) THEN 'G3' END, CASE WHEN NOT joint_lower > 0 THEN 'G4' END, CASE WHEN NOT flip_lower > 0 THEN 'G5' END) AS failed,
 (joint_lower <= 0 AND joint_upper >= 0 OR flip_lower <= 0 AND flip_upper >= 0) AS holds FROM p)
SELECT passing, failed, CASE WHEN failed = '' THEN 'GO' WHEN base AND NOT (g4 AND g5) AND holds THEN 'INCONCLUSIVE' ELSE 'NO_GO' END AS verdict FROM c"""
)
def stop_go(spark: Spark, folder: str) -> Rows:
    """The ten clauses over three seeds: floors, differences with their bounds, safety, calibration and completeness."""
    v = F.avg("value")
    made = {"joint": v / 100, "flip": v / 80, "margin": v / 55, "joint_delta": F.lit(0.12), "joint_lower": v / 1000 - 0.06, "joint_upper": v / 1000, "flip_lower": v / 1000 - 0.04, "flip_upper": v / 1000, "margin_lower": F.lit(-0.01)}
    fixed = {"macro_f1": F.lit(0.5), "accuracy": F.lit(0.6), "macro_f1_lower": F.lit(-0.02), "accuracy_lower": F.lit(-0.01), "calibrated": F.count(F.lit(1)) > 0, "complete": F.count(F.lit(1)) > 10}
    rows = table(spark, folder, "events").groupBy((F.col("user_id") % 3).alias("seed")).agg(*[c.alias(n) for n, c in (made | fixed).items()])
    return B.verdict(rows, 0, True)


_NORM = "lower(trim(regexp_replace(claim, '[ \\t\\n\\r]+', ' ', 'g')))"


@query(
    f"""WITH x AS (SELECT claim_group_id k, {_NORM} t, lower(trim(split)) sp, source FROM verification_example WHERE claim_group_id IS NOT NULL AND claim IS NOT NULL AND split IS NOT NULL), g AS (SELECT DISTINCT k, t FROM x WHERE sp = 'train'), p AS (SELECT k, t, count(*) n FROM x WHERE sp <> 'train' GROUP BY ALL),
c AS (SELECT k, source FROM x WHERE sp <> 'train' AND source IS NOT NULL), o AS (SELECT DISTINCT k, source FROM x WHERE sp = 'train' AND source IS NOT NULL), b AS (SELECT count(*) FILTER (gg) gold, count(*) FILTER (gg AND n IS NOT NULL) covered, coalesce(sum(n), 0) predicted, coalesce(sum(n) FILTER (contains(t, ' and ')), 0) compound,
 coalesce(sum(n - 1), 0) duplicates, coalesce(sum(n) FILTER (gg IS NULL), 0) unsupported FROM (SELECT k, t, true AS gg FROM g) FULL JOIN p USING (k, t)), d AS (SELECT count(*) citations, count(*) FILTER ((k, source) IN (SELECT (k, source) FROM o)) resolved FROM c)
SELECT CAST(gold AS BIGINT) gold, covered, CAST(predicted AS BIGINT) predicted, CAST(compound AS BIGINT) compound, CAST(duplicates AS BIGINT) duplicates, CAST(unsupported AS BIGINT) unsupported, citations, resolved, round(covered / gold, 9) AS coverage, round(resolved / citations, 9) AS resolution_rate FROM b, d"""
)
def extraction_metrics(spark: Spark, folder: str) -> Rows:
    """Claims of the other splits as texts extracted for the training claims of their group; sources are citations."""
    rows = table(spark, folder, "verification_example").dropna(subset=["claim_group_id", "claim", "split"])
    text = F.lower(F.trim(F.regexp_replace("claim", "[ \\t\\n\\r]+", " ")))
    rows = rows.select(F.col("claim_group_id").alias("case"), text.alias("text"), (fold(F.col("split")) == "train").alias("train"), F.col("source").alias("cited"))
    gold, said = rows.filter("train"), rows.filter("not train")
    compound = rows.filter(F.contains("text", F.lit(" and ")))
    out = B.extraction_metrics(gold, said, compound, said.dropna(subset=["cited"]), gold.dropna(subset=["cited"]))
    return out.withColumns({c: F.round(c, 9) for c in ("coverage", "resolution_rate")})


@query(
    f"""WITH {_PR}, q AS (SELECT dom, cs, (line + 1) // 2 AS pair, max(ps) FILTER (line % 2 = 1) a, max(ps) FILTER (line % 2 = 0) b, count(*) n FROM pr GROUP BY ALL)
SELECT dom, count(*) AS queries, round(avg((a >= b)::INT), 9) AS recall_at_1, round(avg(CASE WHEN a >= b THEN 1 ELSE 0.5 END), 9) AS mrr FROM q WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY dom"""
)
def contrastive_ranking(spark: Spark, folder: str) -> Rows:
    """The odd line of a pair of lines as the right candidate, the even one as the wrong one."""
    odd = F.col("line") % 2 == 1
    pairs = _predictions(spark, folder).groupBy("dom", "cs", F.floor((F.col("line") + 1) / 2)).agg(F.max(F.when(odd, F.col("ps"))).alias("right"), F.max(F.when(~odd, F.col("ps"))).alias("wrong"))
    return B.contrastive_ranking(pairs.dropna(subset=["right", "wrong"]), "dom").withColumns({c: F.round(c, 9) for c in ("recall_at_1", "mrr")})


@query(
    with_parts(
        "st0 stw anw an0",
        f"""dect AS (SELECT * FROM dec0 WHERE NOT (document_id = '{WITHDRAWN}' AND line <= 3)), {X.states_sql("stt", "dect")}, {X.answers_sql("ant", "stt")}, pp AS (SELECT claim_id, chunk_id, line FROM dec0 WHERE document_id = '{WITHDRAWN}' AND label <> 'neutral')
SELECT 'pair' AS family, count(*) FILTER (line <= 3) AS numerator, count(*) AS denominator FROM pp UNION ALL SELECT 'claim', count(DISTINCT claim_id) FILTER (line <= 3), count(DISTINCT claim_id) FROM pp
UNION ALL SELECT 'status_effect', count(*) FILTER (t.status = w.status), count(*) FROM st0 a JOIN stw w USING (claim_id) JOIN stt t USING (claim_id) WHERE a.status <> w.status
UNION ALL SELECT 'answer_effect', count(*) FILTER (t.status = w.status), count(*) FROM an0 a JOIN anw w USING (answer_id) JOIN ant t USING (answer_id) WHERE a.status <> w.status""",
    )
)
def event_recall(spark: Spark, folder: str) -> Rows:
    """What a treatment that only looks at the first three lines of a claim finds of the effects of a withdrawal: pairs, claims, statuses, answers."""
    rows, claims = X.decisions(spark, folder, P0), X.claims(spark, folder)
    hit = F.col("document_id") == WITHDRAWN
    positive = rows.filter(hit & (F.col("label") != "neutral"))
    before, oracle, treated = (C.claim_statuses(claims, r) for r in (rows, rows.filter(~hit), rows.filter(~(hit & (F.col("line") <= 3)))))
    answers = [C.answer_states(s) for s in (before, oracle, treated)]
    effects = lambda a, b, key: C.differences(a, b, key, ["status"]).select(key, F.col("after.status").alias("status"))
    parts = [
        B.effect_recall("pair", positive, positive.filter("line <= 3"), ["claim_id", "chunk_id"]), B.effect_recall("claim", positive, positive.filter("line <= 3"), ["claim_id"]),
        B.effect_recall("status_effect", effects(before, oracle, "claim_id"), treated, ["claim_id", "status"]), B.effect_recall("answer_effect", effects(answers[0], answers[1], "answer_id"), answers[2], ["answer_id", "status"]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    """WITH c AS (SELECT l_orderkey cs, string_agg(l_returnflag, '' ORDER BY l_linenumber) p, count(*) n, min(l_suppkey) page FROM lineitem GROUP BY 1), e AS (SELECT *, sha256('5' || chr(0) || CAST(page AS VARCHAR) || chr(0) || CAST(cs AS VARCHAR)) draw FROM c WHERE n = 4 AND p LIKE '%N%' AND page % 5 <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY draw, cs) k FROM e) SELECT cs AS case_id, page, row_number() OVER (ORDER BY draw, cs) AS place FROM f WHERE k = 1 QUALIFY place <= 25"""
)
def case_selection(spark: Spark, folder: str) -> Rows:
    """Cases of four rows whose labels match a pattern, none of an excluded page, one a page, the first 25 in the order of their hash."""
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("i"), F.col("l_returnflag").alias("label"), F.col("l_suppkey").alias("page"))
    excluded = rows.select("page").distinct().filter("page % 5 = 0")
    return R.select_cases(rows, "case_id", "i", "label", "page", 4, "%N%", excluded, "5", 25)
