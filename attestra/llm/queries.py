"""The queries of the training-data problems, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table
from . import chunking, mixture, moderation, neighbours, overlap, tokens, topn


def _overlap(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    examples = table(spark, folder, "verification_example").select("example_id", "source", "split", "claim", "evidence")
    return overlap.cross_split_classes(materialize(overlap.canonical_records(examples)))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_pairs(*_overlap(spark, folder))


def p1_overlap_by_record(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_by_record(*_overlap(spark, folder)).select("example_id", "split", "source", "cid", "links")


def p1_overlap_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(*_overlap(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "impact_channel_hit").select("candidate_policy_id", "chunk_version_id", "claim_id", "rank", "score")
    policy = table(spark, folder, "controlled_policy").select("policy_id", F.col("approximate_budget_per_inserted_chunk").alias("budget"))
    rows = hits.filter(F.col("rank") >= 1).join(policy, hits["candidate_policy_id"] == policy["policy_id"])
    best = topn.top_n(rows, ["candidate_policy_id", "chunk_version_id"], [("rank", True), ("score", False)], "claim_id", "budget")
    return best.select("candidate_policy_id", "chunk_version_id", "claim_id")


def _pieces(spark: SparkSession, folder: str, with_text: bool) -> DataFrame:
    versions = table(spark, folder, "document_version").select("document_version_id", "chunker_artifact_id", "raw_text")
    config = table(spark, folder, "chunker_config").select("artifact_id", "max_characters", "overlap_characters")
    rows = versions.join(config, versions["chunker_artifact_id"] == config["artifact_id"])
    return chunking.chunk_texts(rows, "document_version_id", "raw_text", "max_characters", "overlap_characters", with_text)


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder, True)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    reasons = F.array_compact(F.array(*[F.when(F.col(r), F.lit(r)) for r in ("over_limit", "no_boundary")]))
    first = _pieces(spark, folder, False).filter("piece = 0 and document_version_id is not null")
    return first.select("document_version_id", F.explode(reasons).alias("reason")).distinct()


def _similar(spark: SparkSession, folder: str, floor: bool, leaf_rows: int) -> DataFrame:
    """The search of problem 4; ``floor``: only at ``min_similarity`` or more."""
    config = table(spark, folder, "retrieval_config").select("claim_top_k", "min_similarity", "dimension").first()
    least = config["min_similarity"] if floor else -1.0
    staged = table(spark, folder, "staged_embedding")
    return neighbours.most_similar(
        staged, "chunk_version_id", "model_artifact_id", "embedding", "staged_at", config["claim_top_k"], config["dimension"], least, leaf_rows=leaf_rows
    )


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return _similar(spark, folder, False, neighbours.FAR_LEAF_ROWS)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neighbours.similar_pairs(_similar(spark, folder, True, neighbours.LEAF_ROWS))
    return pairs.toDF("model_artifact_id", "chunk_version_id_a", "chunk_version_id_b")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_texts(table(spark, folder, "documents"), "doc_id", "text", length="n_chars")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixture.mix(documents, "doc_id", "source", "text", table(spark, folder, "mixture_target"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    tagger = moderation.fit(table(spark, folder, "moderation_example"), "text", "category")
    documents = table(spark, folder, "documents").select("doc_id", mixture.source_name(F.col("source")).alias("source"), "text")
    return moderation.score_texts(documents, "doc_id", "text", tagger, keep=("source",))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_scores(spark, folder).filter(F.col("score") >= moderation.THRESHOLD).select("doc_id")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    toxic = F.col("score") >= moderation.THRESHOLD
    rows = p8_scores(spark, folder).groupBy("source")
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.count_if(toxic).alias("toxic"), F.avg(toxic.cast("int")).alias("rate"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}
