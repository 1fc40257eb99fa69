"""Checks, selections and adapters beside the main views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.models import softmax
from ..operators import claims as C
from ..operators.paragraphs import evidence_units as units
from ..operators.paragraphs import paragraph_chunks as chunked
from ..operators.records import sample_draw
from ..session import table
from . import fixtures as X
from .fixtures import P0, WITHDRAWN, with_parts
from .registry import query

Spark, Rows = SparkSession, DataFrame


@query()
def paragraph_chunks(spark: Spark, folder: str) -> Rows:
    return chunked(table(spark, folder, "documents"), "doc_id", "text")


@query(
    with_parts(
        "fx_obs",
        "SELECT observation_id, round(exp(s / 1.5) / (exp(s / 1.5) + exp(r / 1.5) + exp(n / 1.5)), 9) AS support, round(exp(r / 1.5) / (exp(s / 1.5) + exp(r / 1.5) + exp(n / 1.5)), 9) AS refute FROM fx_obs",
    )
)
def softmax_probabilities(spark: Spark, folder: str) -> Rows:
    p = softmax([F.col("s"), F.col("r"), F.col("n")], 1.5)
    return X.observations(spark, folder).select("observation_id", F.round(p[0], 9).alias("support"), F.round(p[1], 9).alias("refute"))


@query(
    """SELECT l_orderkey AS claim_id, l_linestatus AS epoch, count(*) AS observations, count(DISTINCT l_partkey) FILTER (l_quantity / 50.0 >= 0.8 AND l_quantity / 50.0 > l_discount * 10.0 AND l_quantity / 50.0 > l_tax * 12.5) AS supporting_chunks FROM lineitem GROUP BY ALL"""
)
def claim_state_by_epoch(spark: Spark, folder: str) -> Rows:
    """Support of each claim within each epoch: the epoch joins the key."""
    line = table(spark, folder, "lineitem")
    s, r, n = F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0, F.col("l_tax") * 12.5
    rows = line.select(F.col("l_orderkey").alias("claim_id"), F.col("l_linestatus").alias("epoch"), "l_partkey", ((s >= 0.8) & (s > r) & (s > n)).alias("ok"))
    per_chunk = rows.groupBy("claim_id", "epoch", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.bool_or("ok").alias("ok"))
    return per_chunk.groupBy("claim_id", "epoch").agg(F.sum("n").alias("observations"), F.count_if("ok").alias("supporting_chunks"))


@query("SELECT l_returnflag AS stratum, l_linestatus AS status, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def stratified_counts(spark: Spark, folder: str) -> Rows:
    line = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("stratum"), F.col("l_linestatus").alias("status"), "l_linenumber")
    return line.cube("stratum", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


@query(
    """WITH h AS (SELECT DISTINCT epoch_id, chunk_version_id c, claim_id, rank, CASE WHEN isnan(score) THEN NULL ELSE score END s FROM impact_channel_hit WHERE channel = 'vector' AND claim_id IS NOT NULL AND rank >= 1),
p AS (SELECT *, row_number() OVER (PARTITION BY epoch_id, c ORDER BY rank, claim_id, s DESC NULLS LAST) a, row_number() OVER (PARTITION BY epoch_id, c ORDER BY s DESC NULLS LAST, claim_id, rank) b FROM h)
SELECT epoch_id, c AS chunk_version_id, count(*) AS hits, count(*) FILTER (a <> b) AS misplaced FROM p GROUP BY ALL HAVING count(*) FILTER (a <> b) > 0"""
)
def directional_order_check(spark: Spark, folder: str) -> Rows:
    """Events and chunks whose ranks don't follow the score, descending, and the claim."""
    hits = table(spark, folder, "impact_channel_hit").filter("channel = 'vector' and claim_id is not null and rank >= 1")
    rows = hits.select("epoch_id", "chunk_version_id", "claim_id", "rank", F.nanvl("score", F.lit(None).cast("double")).alias("s")).distinct()
    group = Window.partitionBy("epoch_id", "chunk_version_id")
    by_rank = F.row_number().over(group.orderBy("rank", "claim_id", F.col("s").desc_nulls_last()))
    by_score = F.row_number().over(group.orderBy(F.col("s").desc_nulls_last(), "claim_id", "rank"))
    placed = rows.select("epoch_id", "chunk_version_id", (by_rank != by_score).alias("wrong"))
    return placed.groupBy("epoch_id", "chunk_version_id").agg(F.count(F.lit(1)).alias("hits"), F.count_if("wrong").alias("misplaced")).filter("misplaced > 0")


@query(
    """WITH m AS (SELECT document_id, max(epoch_id) e FROM m4_update WHERE document_id IS NOT NULL GROUP BY 1) SELECT m.document_id, e AS head_epoch, count(DISTINCT coalesce(u.document_version_id, '')) > 1 AS conflict
 FROM m JOIN m4_update u ON u.document_id = m.document_id AND u.epoch_id = m.e GROUP BY ALL"""
)
def frontier_heads(spark: Spark, folder: str) -> Rows:
    """The greatest epoch of each document; rows of that epoch with different versions are a conflict."""
    rows = table(spark, folder, "m4_update").dropna(subset=["document_id", "epoch_id"]).select("document_id", "epoch_id", F.coalesce("document_version_id", F.lit("")).alias("v"))
    at = rows.groupBy("document_id", "epoch_id").agg(F.count_distinct("v").alias("n"))
    head = at.groupBy("document_id").agg(F.max(F.struct("epoch_id", "n")).alias("x"))
    return head.select("document_id", F.col("x.epoch_id").alias("head_epoch"), (F.col("x.n") > 1).alias("conflict"))


@query(
    with_parts(
        "fx_chunk",
        """b AS (SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY sha256('3' || chr(0) || document_id || chr(0) || CAST(chunk_id AS VARCHAR)), chunk_id) k FROM fx_chunk WHERE NOT active)
SELECT document_id, chunk_id FROM b WHERE k = 1""",
    )
)
def neutral_pick(spark: Spark, folder: str) -> Rows:
    """One chunk of each document outside the forbidden (active) set, by a hash draw."""
    rows = X.chunks(spark, folder).filter("not active").select("document_id", "chunk_id").withColumn("draw", sample_draw("3", "document_id", "chunk_id"))
    return rows.groupBy("document_id").agg(F.min(F.struct("draw", "chunk_id")).alias("x")).select("document_id", "x.chunk_id")


@query("SELECT 'hits_only' AS side, chunk_version_id AS k FROM (SELECT chunk_version_id FROM impact_channel_hit EXCEPT SELECT chunk_version_id FROM staged_embedding) UNION ALL SELECT 'staged_only', chunk_version_id FROM (SELECT chunk_version_id FROM staged_embedding EXCEPT SELECT chunk_version_id FROM impact_channel_hit)")
def key_set_diff(spark: Spark, folder: str) -> Rows:
    a, b = (table(spark, folder, t).select(F.col("chunk_version_id").alias("k")).distinct() for t in ("impact_channel_hit", "staged_embedding"))
    one = a.join(b, a["k"].eqNullSafe(b["k"]), "left_anti").select(F.lit("hits_only").alias("side"), "k")
    return one.unionByName(b.join(a, b["k"].eqNullSafe(a["k"]), "left_anti").select(F.lit("staged_only").alias("side"), "k"))


@query(
    """WITH v AS (SELECT document_id d, document_version_id v, valid_from_epoch f, valid_to_epoch t FROM (SELECT DISTINCT document_id, document_version_id, valid_from_epoch, valid_to_epoch FROM document_version)),
n AS (SELECT *, lead(f) OVER (PARTITION BY d ORDER BY f, v) nx FROM v) SELECT d AS document_id, v AS document_version_id, t AS valid_to, nx AS next_from, CASE WHEN t IS NULL THEN 'open_before_next' WHEN t < nx THEN 'gap' ELSE 'overlap' END AS fault FROM n WHERE nx IS NOT NULL AND t IS DISTINCT FROM nx"""
)
def currency_chain_check(spark: Spark, folder: str) -> Rows:
    """Versions that don't end where the next of their document begins."""
    rows = table(spark, folder, "document_version").select("document_id", "document_version_id", F.col("valid_from_epoch").alias("f"), F.col("valid_to_epoch").alias("valid_to")).distinct()
    chained = rows.withColumn("next_from", F.lead("f").over(Window.partitionBy("document_id").orderBy("f", "document_version_id")))
    bad = chained.filter(F.col("next_from").isNotNull() & ~F.col("valid_to").eqNullSafe(F.col("next_from")))
    fault = F.when(F.col("valid_to").isNull(), "open_before_next").when(F.col("valid_to") < F.col("next_from"), "gap").otherwise("overlap")
    return bad.select("document_id", "document_version_id", "valid_to", "next_from", fault.alias("fault"))


@query(
    """WITH v AS (SELECT DISTINCT document_id d, document_version_id v, valid_from_epoch f, valid_to_epoch t FROM document_version), u AS (SELECT epoch_id, document_id, max(previous_published_epoch_id) p FROM m4_update WHERE epoch_id IS NOT NULL GROUP BY ALL)
SELECT epoch_id, document_id, v AS document_version_id FROM u JOIN v ON d = document_id AND f <= p AND (t IS NULL OR p < t)"""
)
def effective_document_versions(spark: Spark, folder: str) -> Rows:
    """Versions in force at the epoch published before each event."""
    from ..operators.temporal import interval_join

    events = table(spark, folder, "m4_update").dropna(subset=["epoch_id"]).groupBy("epoch_id", "document_id").agg(F.max("previous_published_epoch_id").alias("p"))
    spans = table(spark, folder, "document_version").select("document_id", "document_version_id", F.col("valid_from_epoch").alias("valid_from"), F.col("valid_to_epoch").alias("valid_to")).distinct()
    return interval_join(events, spans, ["document_id"], "p").select("epoch_id", "document_id", "document_version_id")


@query(
    """WITH a AS (SELECT chunk_version_id c, claim_id i, min(rank) r FROM impact_channel_hit WHERE channel = 'vector' AND claim_id IS NOT NULL AND rank >= 1 GROUP BY ALL), b AS (SELECT chunk_version_id c, claim_id i, min(rank) r FROM impact_channel_hit WHERE channel = 'lexical' AND claim_id IS NOT NULL AND rank >= 1 GROUP BY ALL)
SELECT c AS chunk_version_id, count(*) AS pairs, count(*) FILTER (a.r IS NOT NULL AND b.r IS NOT NULL) AS aligned, count(*) FILTER (b.r IS NULL) AS first_only, count(*) FILTER (a.r IS NULL) AS second_only, count(*) FILTER (a.r <> b.r) AS differing FROM a FULL JOIN b USING (c, i) GROUP BY c"""
)
def paired_alignment(spark: Spark, folder: str) -> Rows:
    """Two runs aligned on their pairs: what both have, what one misses, and where they disagree."""
    hits = table(spark, folder, "impact_channel_hit").filter("channel in ('vector', 'lexical') and claim_id is not null and rank >= 1")
    both = hits.groupBy("chunk_version_id", "claim_id").agg(*[F.min(F.when(F.col("channel") == c, F.col("rank"))).alias(n) for c, n in (("vector", "a"), ("lexical", "b"))])
    a, b = F.col("a"), F.col("b")
    return both.groupBy("chunk_version_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(a.isNotNull() & b.isNotNull()).alias("aligned"), F.count_if(b.isNull()).alias("first_only"), F.count_if(a.isNull()).alias("second_only"), F.count_if(a != b).alias("differing"),
    )


@query(
    with_parts(
        "edge fx_chunk",
        f"""g AS (SELECT DISTINCT text_hash FROM fx_chunk WHERE active AND document_id = '{WITHDRAWN}'), k AS (SELECT DISTINCT text_hash FROM fx_chunk WHERE active AND document_id <> '{WITHDRAWN}')
SELECT group_id, ordinal, count(DISTINCT text_hash) AS hashes, count(DISTINCT text_hash) FILTER (text_hash NOT IN (SELECT text_hash FROM k)) AS lost FROM edge WHERE text_hash IN (SELECT text_hash FROM g) GROUP BY ALL""",
    )
)
def requirement_withdrawal(spark: Spark, folder: str) -> Rows:
    """Requirements whose witnesses a withdrawal touches, and how many of their hashes no other document carries."""
    active = X.chunks(spark, folder).filter("active").groupBy("text_hash")
    hashes = active.agg(F.bool_or(F.col("document_id") == WITHDRAWN).alias("hit"), F.bool_and(F.col("document_id") == WITHDRAWN).alias("only")).filter("hit")
    edges = X.edges(spark, folder).select("group_id", "ordinal", "text_hash").distinct().join(hashes, "text_hash")
    return edges.groupBy("group_id", "ordinal").agg(F.count(F.lit(1)).alias("hashes"), F.count_if("only").alias("lost"))


@query(
    """WITH o AS (SELECT chunk_version_id, claim_id, list_distinct(list(channel)) r FROM impact_channel_hit WHERE claim_id IS NOT NULL GROUP BY ALL)
SELECT chunk_version_id, claim_id, list_contains(r, 'lineage') AS mandatory, len(list_filter(r, lambda x: x NOT IN ('vector', 'lexical', 'lineage', 'frontier'))) AS foreign_reasons FROM o"""
)
def reason_containment(spark: Spark, folder: str) -> Rows:
    """Pairs with their lineage flag and the number of reasons outside the allowed ones."""
    hits = table(spark, folder, "impact_channel_hit").filter("claim_id is not null")
    rows = hits.groupBy("chunk_version_id", "claim_id").agg(F.collect_set("channel").alias("r"))
    allowed = F.array(*[F.lit(x) for x in ("vector", "lexical", "lineage", "frontier")])
    return rows.select("chunk_version_id", "claim_id", F.array_contains("r", "lineage").alias("mandatory"), F.size(F.array_except("r", allowed)).alias("foreign_reasons"))


@query(
    """WITH u AS (SELECT claim_group_id k, list_distinct(list(claim)) s FROM verification_example WHERE claim_group_id IS NOT NULL AND claim IS NOT NULL GROUP BY 1)
SELECT k AS claim_group_id, len(s) AS sentences, list_bool_or(list_transform(s, lambda x: trim(x, ' ') = '')) AS has_blank, list_sum(list_transform(s, lambda x: length(x))) + len(s) - 1 > 160 AS too_long FROM u"""
)
def evidence_units(spark: Spark, folder: str) -> Rows:
    """The different claims of each group as one unit, with the reason for which it would be rejected."""
    rows = table(spark, folder, "verification_example").dropna(subset=["claim_group_id", "claim"]).withColumn("i", F.lit(0))
    built = units(rows, "claim_group_id", "i", "claim", 160)
    lines = F.from_json("unit", "array<string>")
    long = F.char_length(F.array_join(lines, " ")) > 160
    return built.select("claim_group_id", F.size(lines).alias("sentences"), (F.col("reason") == "empty").eqNullSafe(F.lit(True)).alias("has_blank"), long.alias("too_long"))


@query(
    with_parts(
        "st0",
        "SELECT c.answer_id, count(*) AS claims, bool_and(status = 'supported') AS all_supported, coalesce(string_agg(CAST(claim_id AS VARCHAR), ',' ORDER BY claim_id) FILTER (status = 'refuted'), '') AS refuted FROM st0 c GROUP BY c.answer_id",
    )
)
def answer_evidence(spark: Spark, folder: str) -> Rows:
    """Every answer with the refuted claims among all of its claims, required or not."""
    states = C.claim_statuses(X.claims(spark, folder), X.decisions(spark, folder, P0))
    ids = F.sort_array(F.collect_list(F.when(F.col("status") == "refuted", F.col("claim_id"))))
    return states.groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("claims"), F.bool_and(F.col("status") == "supported").alias("all_supported"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("refuted")
    )
