"""Full-recompute views, certificates, temporal lookups and deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policy import argmax_label, potential_partition
from ..operators import claims as C
from ..operators import deltas as D
from ..operators import temporal as T
from ..operators.shape import side_by_side
from . import fixtures as X
from .fixtures import P0, P1, WITHDRAWN, label_sql, with_parts
from .registry import query

_STATE = "claim_id, answer_id, required, support_count, refute_count, best_support, best_refute, support_ids, refute_ids, status"
_ANSWER = "answer_id, required_count, supported_count, refuted_count, conflicted_count, unsupported_count, status"
Spark, Rows = SparkSession, DataFrame


def _states(spark: Spark, folder: str, policy: tuple[float, float], keep=None) -> Rows:
    return C.claim_states(X.claims(spark, folder), X.decisions(spark, folder, policy, keep))


def _statuses(spark: Spark, folder: str, policy: tuple[float, float], keep=None) -> Rows:
    return C.claim_statuses(X.claims(spark, folder), X.decisions(spark, folder, policy, keep))


_KEPT = f"document_id <> '{WITHDRAWN}'"


@query(with_parts("dec0", "SELECT observation_id, claim_id, chunk_id, label FROM dec0"))
def decision(spark: Spark, folder: str) -> Rows:
    return X.decisions(spark, folder, P0).select("observation_id", "claim_id", "chunk_id", "label")


@query(
    with_parts("fx_obs", "SELECT observation_id, CASE WHEN s > r AND s > n THEN 'support_capable' WHEN r >= s AND r >= n THEN 'refute_capable' ELSE 'always_neutral' END AS part FROM fx_obs")
)
def potential_partitions(spark: Spark, folder: str) -> Rows:
    return X.observations(spark, folder).select("observation_id", potential_partition("s", "r", "n").alias("part"))


@query(
    with_parts("fx_obs", "SELECT observation_id, CASE WHEN s >= r AND s >= n THEN 'support' WHEN r >= s AND r >= n THEN 'refute' ELSE 'neutral' END AS predicted FROM fx_obs")
)
def argmax_prediction(spark: Spark, folder: str) -> Rows:
    return X.observations(spark, folder).select("observation_id", argmax_label("s", "r", "n").alias("predicted"))


@query(with_parts("st0", f"SELECT {_STATE} FROM st0"))
def claim_state(spark: Spark, folder: str) -> Rows:
    return _states(spark, folder, P0)


@query(with_parts("an0", f"SELECT {_ANSWER} FROM an0"))
def answer_state(spark: Spark, folder: str) -> Rows:
    return C.answer_states(_statuses(spark, folder, P0))


@query(with_parts("an0", "SELECT status, count(*) AS answers FROM an0 GROUP BY status"))
def answer_status_counts(spark: Spark, folder: str) -> Rows:
    return C.answer_states(_statuses(spark, folder, P0)).groupBy("status").agg(F.count(F.lit(1)).alias("answers"))


@query(with_parts("st0", "SELECT claim_id, support_least AS support_id, refute_least AS refute_id FROM st0 WHERE status <> 'unsupported'"))
def claim_certificate(spark: Spark, folder: str) -> Rows:
    return C.least_certificates(X.decisions(spark, folder, P0))


@query(
    with_parts(
        "st0 st1",
        """SELECT a.claim_id, (a.support_least IS NULL OR list_contains(string_split(b.support_ids, ','), a.support_least)) AS support_valid,
 (a.refute_least IS NULL OR list_contains(string_split(b.refute_ids, ','), a.refute_least)) AS refute_valid FROM st0 a JOIN st1 b USING (claim_id) WHERE a.status <> 'unsupported'""",
    )
)
def certificate_validity(spark: Spark, folder: str) -> Rows:
    rows = X.labelled(X.labelled(X.active_current(spark, folder), P0), P1, "later")

    def least(label: str, column: str):
        return F.min(F.when(F.col("label") == label, F.struct("observation_id", (F.col("later") == label).alias("holds")))).alias(column)

    kept = rows.filter("label <> 'neutral'").groupBy("claim_id").agg(least("support", "a"), least("refute", "b"))
    return kept.select("claim_id", *[F.coalesce(F.col(f"{x}.holds"), F.lit(True)).alias(f"{name}_valid") for x, name in (("a", "support"), ("b", "refute"))])


@query(
    with_parts(
        "st0 st1",
        """SELECT claim_id, a.status AS before_status, b.status AS after_status FROM st0 a FULL JOIN st1 b USING (claim_id)
 WHERE (a.support_count, a.refute_count, a.best_support, a.best_refute, a.support_ids, a.refute_ids, a.status) IS DISTINCT FROM (b.support_count, b.refute_count, b.best_support, b.best_refute, b.support_ids, b.refute_ids, b.status)""",
    )
)
def claim_mismatch(spark: Spark, folder: str) -> Rows:
    rows = C.differences(_states(spark, folder, P0), _states(spark, folder, P1), "claim_id", C.STATE)
    return rows.select("claim_id", F.col("before.status").alias("before_status"), F.col("after.status").alias("after_status"))


@query(
    with_parts(
        "an0 anw",
        """SELECT answer_id, a.status AS before_status, b.status AS after_status FROM an0 a FULL JOIN anw b USING (answer_id)
 WHERE (a.required_count, a.supported_count, a.refuted_count, a.conflicted_count, a.status) IS DISTINCT FROM (b.required_count, b.supported_count, b.refuted_count, b.conflicted_count, b.status)""",
    )
)
def answer_mismatch(spark: Spark, folder: str) -> Rows:
    before, after = C.answer_states(_statuses(spark, folder, P0)), C.answer_states(_statuses(spark, folder, P0, _KEPT))
    rows = C.differences(before, after, "answer_id", ["required_count", "supported_count", "refuted_count", "conflicted_count", "status"])
    return rows.select("answer_id", F.col("before.status").alias("before_status"), F.col("after.status").alias("after_status"))


@query(
    with_parts(
        "st0 st1 stw",
        """SELECT 'policy' AS change, count(*) FILTER (a.status <> b.status) AS status_changes, count(*) FILTER ((a.support_count, a.refute_count) IS DISTINCT FROM (b.support_count, b.refute_count)) AS count_changes
 FROM st0 a JOIN st1 b USING (claim_id) UNION ALL SELECT 'withdrawal', count(*) FILTER (a.status <> b.status), count(*) FILTER ((a.support_count, a.refute_count) IS DISTINCT FROM (b.support_count, b.refute_count)) FROM st0 a JOIN stw b USING (claim_id)""",
    )
)
def mismatch_counts(spark: Spark, folder: str) -> Rows:
    def of(name: str, after: Rows) -> Rows:
        rows = C.differences(_states(spark, folder, P0), after, "claim_id", ["status", "support_count", "refute_count"])
        counts = F.struct("before.support_count", "before.refute_count") != F.struct("after.support_count", "after.refute_count")
        return rows.agg(F.lit(name).alias("change"), F.count_if(F.col("before.status") != F.col("after.status")).alias("status_changes"), F.count_if(counts).alias("count_changes"))

    return of("policy", _states(spark, folder, P1)).unionByName(of("withdrawal", _states(spark, folder, P0, _KEPT)))


# temporal lookups


@query(with_parts("fx_current", "SELECT claim_id, chunk_id, observation_id FROM fx_current"))
def currency_latest(spark: Spark, folder: str) -> Rows:
    return X.current(spark, folder).select("claim_id", "chunk_id", "observation_id")


@query(with_parts("fx_chunk", "SELECT chunk_id, document_id, text_hash FROM fx_chunk WHERE valid_from <= 25 AND (valid_to IS NULL OR 25 < valid_to)"))
def effective_chunks_asof(spark: Spark, folder: str) -> Rows:
    return T.as_of(X.chunks(spark, folder), 25).select("chunk_id", "document_id", "text_hash")


@query(
    with_parts(
        "fx_obs fx_chunk",
        "SELECT observation_id, o.chunk_id, o.line * 7 AS epoch FROM fx_obs o JOIN fx_chunk c ON c.chunk_id = o.chunk_id AND valid_from <= o.line * 7 AND (valid_to IS NULL OR o.line * 7 < valid_to)",
    )
)
def observations_in_validity(spark: Spark, folder: str) -> Rows:
    points = X.observations(spark, folder).select("observation_id", "chunk_id", (F.col("line") * 7).alias("epoch"))
    spans = X.chunks(spark, folder).select("chunk_id", "valid_from", "valid_to")
    return T.interval_join(points, spans, ["chunk_id"], "epoch").select("observation_id", "chunk_id", "epoch")


_CUT = "1999-01-01"


@query(
    with_parts(
        "fx_obs",
        f"""l AS (SELECT *, row_number() OVER (PARTITION BY claim_id, chunk_id, shipdate >= DATE '{_CUT}' ORDER BY shipdate DESC, observation_id DESC) rn FROM fx_obs),
b AS (SELECT * FROM l WHERE rn = 1 AND shipdate < DATE '{_CUT}'), d AS (SELECT * FROM l WHERE rn = 1 AND shipdate >= DATE '{_CUT}')
SELECT claim_id, chunk_id, observation_id FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.claim_id = b.claim_id AND d.chunk_id = b.chunk_id) UNION ALL SELECT claim_id, chunk_id, observation_id FROM d WHERE flag <> 'R'""",
    )
)
def effective_currency_overlay(spark: Spark, folder: str) -> Rows:
    rows, key, order = X.observations(spark, folder), ["claim_id", "chunk_id"], ["shipdate", "observation_id"]
    later = F.col("shipdate") >= F.lit(_CUT).cast("timestamp")
    rows = rows.select(*key, *order, "flag")
    base = T.latest(rows.filter(~later), key, order).select(*key, "observation_id")
    return T.overlay(base, T.latest(rows.filter(later), key, order), key, F.col("flag") == "R")


@query(
    with_parts(
        "fx_obs",
        """v AS (SELECT claim_id, chunk_id, observation_id, line AS epoch, CAST(s * 50 AS BIGINT) AS from_revision, CAST(s * 50 AS BIGINT) + 10 AS to_revision, flag FROM fx_obs WHERE line = 4),
p AS (SELECT claim_id, chunk_id, max(observation_id) observation_id FROM fx_obs WHERE line <= 3 GROUP BY ALL)
SELECT claim_id, chunk_id, observation_id FROM p WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.claim_id = p.claim_id AND v.chunk_id = p.chunk_id)
UNION ALL SELECT claim_id, chunk_id, observation_id FROM v WHERE from_revision <= 20 AND 20 < to_revision AND flag <> 'R'""",
    )
)
def currency_at(spark: Spark, folder: str) -> Rows:
    rows, key = X.observations(spark, folder), ["claim_id", "chunk_id"]
    revision = (F.col("s") * 50).cast("bigint")
    working = rows.filter("line = 4").select(
        *key, F.when(F.col("flag") != "R", F.col("observation_id")).alias("observation_id"), F.col("line").alias("epoch"), revision.alias("from_revision"), (revision + 10).alias("to_revision")
    )
    published = rows.filter("line <= 3").groupBy(*key).agg(F.max("observation_id").alias("observation_id"))
    published = published.withColumn("valid_from", F.lit(1)).withColumn("valid_to", F.lit(None).cast("int"))
    return T.bitemporal_at(published, working, key, 4, 20, "observation_id")


@query(
    with_parts(
        "fx_obs",
        "SELECT observation_id, claim_id, shipdate AS valid_from, lead(shipdate) OVER (PARTITION BY claim_id, chunk_id ORDER BY shipdate, observation_id) AS valid_to FROM fx_obs",
    )
)
def scd2_intervals(spark: Spark, folder: str) -> Rows:
    rows = X.observations(spark, folder).select("observation_id", "claim_id", "chunk_id", F.col("shipdate").alias("valid_from"))
    return T.close_intervals(rows, ["claim_id", "chunk_id"], "valid_from", "valid_to", ["observation_id"]).drop("chunk_id")


@query(
    with_parts(
        "fx_chunk",
        """a AS (SELECT *, row_number() OVER (PARTITION BY document_id, text ORDER BY valid_from, chunk_id) n FROM fx_chunk)
SELECT b.chunk_id, b.document_id FROM a b WHERE EXISTS (SELECT 1 FROM a WHERE a.document_id = b.document_id AND a.text = b.text AND a.n < b.n AND (a.valid_to IS NULL OR b.valid_from < a.valid_to))""",
    )
)
def interval_overlap_check(spark: Spark, folder: str) -> Rows:
    return T.overlaps(X.chunks(spark, folder), ["document_id", "text"], ["chunk_id"]).select("chunk_id", "document_id")


@query(with_parts("fx_chunk", "SELECT document_id, text, count(*) AS open_rows FROM fx_chunk WHERE valid_to IS NULL GROUP BY ALL HAVING count(*) > 1"))
def one_open_row_check(spark: Spark, folder: str) -> Rows:
    return T.several_open(X.chunks(spark, folder), ["document_id", "text"])


@query(
    """WITH r AS (SELECT epoch_id, document_id, document_version_id, lower(trim(update_kind, ' \t\n\r')) kind, previous_published_epoch_id p FROM m4_update WHERE lower(trim(update_kind, ' \t\n\r')) IN ('insert', 'replace', 'delete') AND epoch_id IS NOT NULL AND document_id IS NOT NULL),
e AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY epoch_id ORDER BY p DESC NULLS LAST, document_id DESC, kind DESC, document_version_id DESC NULLS LAST) k FROM r) WHERE k = 1)
SELECT document_id, document_version_id, epoch_id AS valid_from, lead(epoch_id) OVER (PARTITION BY document_id ORDER BY epoch_id) AS valid_to FROM e QUALIFY kind <> 'delete'"""
)
def document_version_history(spark: Spark, folder: str) -> Rows:
    """Every version a document ever had with its interval: deletes close one and open none."""
    from .pipeline import applied_epochs

    rows = applied_epochs(spark, folder).withColumnRenamed("epoch_id", "valid_from")
    closed = T.close_intervals(rows, ["document_id"], "valid_from", "valid_to")
    return closed.filter("kind <> 'delete'").select("document_id", "document_version_id", "valid_from", "valid_to")


# deltas


@query(
    with_parts(
        "fx_current fx_chunk",
        f"""SELECT observation_id, claim_id, {label_sql(P0)} AS old_label, {label_sql(P1)} AS new_label FROM fx_current o JOIN fx_chunk c ON c.chunk_id = o.chunk_id AND active WHERE {label_sql(P0)} <> {label_sql(P1)}""",
    )
)
def policy_flips_range(spark: Spark, folder: str) -> Rows:
    return D.flips_by_range(X.active_current(spark, folder), P0, P1).select("observation_id", "claim_id", "old_label", "new_label")


@query(
    with_parts(
        "fx_current fx_chunk",
        f"""SELECT observation_id, claim_id, {label_sql(P0)} AS old_label, {label_sql(P1)} AS new_label FROM fx_current o JOIN fx_chunk c ON c.chunk_id = o.chunk_id AND active WHERE {label_sql(P0)} <> {label_sql(P1)}""",
    )
)
def policy_flips_exact(spark: Spark, folder: str) -> Rows:
    return D.flips_by_partition(X.active_current(spark, folder), P0, P1).select("observation_id", "claim_id", "old_label", "new_label")


@query(
    with_parts(
        "fx_current fx_chunk", f"SELECT claim_id, chunk_id, observation_id FROM fx_current WHERE chunk_id IN (SELECT chunk_id FROM fx_chunk WHERE active AND document_id = '{WITHDRAWN}')"
    )
)
def withdrawal_plan(spark: Spark, folder: str) -> Rows:
    gone = X.chunks(spark, folder).filter(f"active and document_id = '{WITHDRAWN}'")
    return D.withdrawn(X.current(spark, folder), gone, "chunk_id").select("claim_id", "chunk_id", "observation_id")


@query(
    with_parts(
        "fx_current fx_chunk",
        f"""SELECT c.claim_id, c.answer_id FROM (SELECT o_orderkey claim_id, o_custkey answer_id FROM orders) c WHERE claim_id IN (SELECT claim_id FROM fx_current WHERE chunk_id IN (SELECT chunk_id FROM fx_chunk WHERE active AND document_id = '{WITHDRAWN}'))""",
    )
)
def affected_claims_delete(spark: Spark, folder: str) -> Rows:
    pairs = withdrawal_plan(spark, folder)
    return X.claims(spark, folder).join(pairs.select("claim_id").distinct(), "claim_id", "left_semi").select("claim_id", "answer_id")


_SIGNED = """sg AS (SELECT claim_id, label, text_hash, CAST(sum(d) AS BIGINT) AS delta FROM (SELECT claim_id, label, text_hash, -1 d FROM dec0 WHERE label <> 'neutral' UNION ALL SELECT claim_id, label, text_hash, 1 FROM dec1 WHERE label <> 'neutral') GROUP BY ALL HAVING sum(d) <> 0)"""


@query(with_parts("dec0 dec1", _SIGNED + " SELECT claim_id, label, text_hash, delta FROM sg"))
def signed_contributions(spark: Spark, folder: str) -> Rows:
    return D.signed_deltas(D.flips_by_partition(X.active_current(spark, folder), P0, P1))


@query(
    with_parts(
        "dec0 dec1",
        """a AS (SELECT claim_id, label, text_hash, count(*) n FROM dec0 WHERE label <> 'neutral' GROUP BY ALL), b AS (SELECT claim_id, label, text_hash, count(*) n FROM dec1 WHERE label <> 'neutral' GROUP BY ALL)
SELECT claim_id, label, text_hash, CASE WHEN a.n IS NULL THEN 1 ELSE -1 END AS crossing FROM a FULL JOIN b USING (claim_id, label, text_hash) WHERE a.n IS NULL OR b.n IS NULL""",
    )
)
def hash_crossings(spark: Spark, folder: str) -> Rows:
    rows = X.active_current(spark, folder)
    state = D.contributions(X.labelled(rows, P0))
    return D.crossings(state, D.signed_deltas(D.flips_by_partition(rows, P0, P1)))


def _deltas_sql(claims: str, answers: str) -> str:
    return f"""SELECT 'claim' AS object_kind, claim_id AS object_id, a.status AS old_status, b.status AS new_status FROM st0 a JOIN {claims} b USING (claim_id) WHERE a.status <> b.status
 UNION ALL SELECT 'answer', answer_id, a.status, b.status FROM an0 a JOIN {answers} b USING (answer_id) WHERE a.status <> b.status"""


def _status_deltas(before: Rows, after: Rows) -> Rows:
    out = C.status_deltas(before, after, "claim_id", "claim")
    return out.unionByName(C.status_deltas(C.answer_states(before), C.answer_states(after), "answer_id", "answer"))


@query(with_parts("an0 an1", _deltas_sql("st1", "an1")))
def status_deltas_policy(spark: Spark, folder: str) -> Rows:
    return _status_deltas(_statuses(spark, folder, P0), _statuses(spark, folder, P1))


@query(with_parts("an0 anw", _deltas_sql("stw", "anw")))
def status_deltas_delete(spark: Spark, folder: str) -> Rows:
    return _status_deltas(_statuses(spark, folder, P0), _statuses(spark, folder, P0, _KEPT))


@query(with_parts("st1", "SELECT claim_id, support_count, refute_count, status FROM st1"))
def incremental_policy_change(spark: Spark, folder: str) -> Rows:
    """State after a policy change from the old state and signed deltas: only touched keys are computed anew."""
    rows = X.active_current(spark, folder)
    old = C.claim_states(X.claims(spark, folder), X.labelled(rows, P0), ids=False)
    flips = D.flips_by_partition(rows, P0, P1)
    held = X.labelled(rows, P0).join(flips.select("claim_id", "text_hash").distinct(), ["claim_id", "text_hash"], "left_semi")
    return D.apply_crossings(old, D.crossings(D.contributions(held), D.signed_deltas(flips)))


@query(with_parts("st0 stw", f"SELECT count(*) AS claims, count(*) FILTER (a.status <> b.status) AS changed, CAST(0 AS BIGINT) AS wrong FROM st0 a JOIN stw b USING (claim_id)"))
def keyed_recompute_equiv(spark: Spark, folder: str) -> Rows:
    """Recomputes only the claims a withdrawal touches and compares the merged result with a full recompute."""
    claims = X.claims(spark, folder)
    old, full = C.claim_statuses(claims, X.decisions(spark, folder, P0)), C.claim_statuses(claims, X.decisions(spark, folder, P0, _KEPT))
    touched = affected_claims_delete(spark, folder).select("claim_id")
    again = C.claim_statuses(claims.join(touched, "claim_id", "left_semi"), X.decisions(spark, folder, P0, _KEPT).join(touched, "claim_id", "left_semi"))
    merged = T.overlay(old, again, ["claim_id"], F.lit(False))
    rows = old.select("claim_id", F.col("status").alias("a")).join(full.select("claim_id", F.col("status").alias("b")), "claim_id", "full")
    rows = rows.join(merged.select("claim_id", F.col("status").alias("c")), "claim_id", "full")
    return rows.agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if(~F.col("b").eqNullSafe(F.col("c"))).alias("wrong"))


@query(
    with_parts(
        "an0 an1",
        """SELECT (SELECT count(*) FROM st0 a JOIN st1 b USING (claim_id) WHERE (a.support_count, a.refute_count, a.best_support, a.best_refute, a.support_ids, a.refute_ids, a.status) IS DISTINCT FROM (b.support_count, b.refute_count, b.best_support, b.best_refute, b.support_ids, b.refute_ids, b.status)) AS whole_row,
 (SELECT count(*) FROM st0 a JOIN st1 b USING (claim_id) WHERE (a.support_count, a.refute_count, a.best_support, a.best_refute, a.status) IS DISTINCT FROM (b.support_count, b.refute_count, b.best_support, b.best_refute, b.status)) AS summary,
 (SELECT count(*) FROM st0 a JOIN st1 b USING (claim_id) WHERE a.status <> b.status) AS status, (SELECT count(*) FROM an0 a JOIN an1 b USING (answer_id) WHERE a.status <> b.status) AS answer_status""",
    )
)
def affected_sets(spark: Spark, folder: str) -> Rows:
    before, after = _states(spark, folder, P0), _states(spark, folder, P1)
    rows = C.differences(before, after, "claim_id", C.STATE)
    summary = [c for c in C.STATE if not c.endswith("_ids")]
    one, two = (F.struct(*[F.col(f"{side}.{c}") for c in summary]) for side in ("before", "after"))
    counts = rows.agg(
        F.count(F.lit(1)).alias("whole_row"), F.count_if(~one.eqNullSafe(two)).alias("summary"), F.count_if(F.col("before.status") != F.col("after.status")).alias("status")
    )
    answers = C.status_deltas(C.answer_states(before), C.answer_states(after), "answer_id", "answer").agg(F.count(F.lit(1)).alias("answer_status"))
    return side_by_side(counts, answers)


@query(
    with_parts(
        "dec0 dec1 an0 an1",
        """a AS (SELECT claim_id, label, text_hash, count(*) n FROM dec0 WHERE label <> 'neutral' GROUP BY ALL), b AS (SELECT claim_id, label, text_hash, count(*) n FROM dec1 WHERE label <> 'neutral' GROUP BY ALL)
SELECT (SELECT count(*) FROM dec0 JOIN dec1 USING (observation_id) WHERE dec0.label <> dec1.label) AS flips,
 (SELECT count(*) FROM a FULL JOIN b USING (claim_id, label, text_hash) WHERE a.n IS NULL) AS added, (SELECT count(*) FROM a FULL JOIN b USING (claim_id, label, text_hash) WHERE b.n IS NULL) AS removed,
 (SELECT count(DISTINCT claim_id) FROM dec0 JOIN dec1 USING (observation_id, claim_id) WHERE dec0.label <> dec1.label) AS claims_touched,
 (SELECT count(DISTINCT a.answer_id) FROM st0 a JOIN st1 b USING (claim_id) WHERE a.required AND a.status <> b.status) AS answers_touched""",
    )
)
def maintenance_counters(spark: Spark, folder: str) -> Rows:
    rows = X.active_current(spark, folder)
    flips = D.flips_by_partition(rows, P0, P1)
    a = flips.agg(F.count(F.lit(1)).alias("flips"), F.count_distinct("claim_id").alias("claims_touched"))
    b = D.crossings(D.contributions(X.labelled(rows, P0)), D.signed_deltas(flips)).agg(F.count_if(F.col("crossing") > 0).alias("added"), F.count_if(F.col("crossing") < 0).alias("removed"))
    changed = C.differences(_statuses(spark, folder, P0), _statuses(spark, folder, P1), "claim_id", ["answer_id", "required", "status"])
    c = changed.filter("before.required").agg(F.count_distinct("before.answer_id").alias("answers_touched"))
    return side_by_side(a, b, c)


@query(
    with_parts(
        "dec0",
        """SELECT claim_id, count(*) AS observations, count(*) FILTER (label = 'support') AS supports, count(*) FILTER (label = 'refute') AS refutes, count(*) FILTER (label = 'neutral') AS neutrals FROM dec0 GROUP BY claim_id""",
    )
)
def claim_label_counts(spark: Spark, folder: str) -> Rows:
    rows = X.decisions(spark, folder, P0).groupBy("claim_id")
    return rows.agg(F.count(F.lit(1)).alias("observations"), *[F.count_if(F.col("label") == x).alias(f"{x}s") for x in ("support", "refute", "neutral")])
