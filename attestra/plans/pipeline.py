"""The general data-pipeline problem: the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold
from ..operators.changefeed import fold_changes, live
from ..session import table
from .registry import query


def applied_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """epoch_id, document_id, kind, document_version_id: of the rows of each epoch the one that counts."""
    feed = table(spark, folder, "m4_update").select(
        "epoch_id", "previous_published_epoch_id", "document_id", fold(F.col("update_kind")).alias("kind"), "document_version_id"
    )
    feed = feed.filter(F.col("kind").isin("insert", "replace", "delete") & F.col("document_id").isNotNull() & F.col("epoch_id").isNotNull())
    # an epoch orders its rows by the epoch published before, null least; further columns only make the order total
    best = feed.groupBy("epoch_id").agg(F.max(F.struct("previous_published_epoch_id", "document_id", "kind", "document_version_id")).alias("x"))
    return best.select("epoch_id", "x.document_id", "x.kind", "x.document_version_id")


def current_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The folded state of all documents, tombstones included."""
    return fold_changes(applied_epochs(spark, folder), ["document_id"], ["epoch_id"], "kind", ["document_version_id"])


@query(
    """WITH r AS (SELECT epoch_id, document_id, document_version_id, lower(trim(update_kind, ' \t\n\r')) kind, previous_published_epoch_id p FROM m4_update WHERE lower(trim(update_kind, ' \t\n\r')) IN ('insert', 'replace', 'delete') AND epoch_id IS NOT NULL AND document_id IS NOT NULL),
e AS (SELECT *, row_number() OVER (PARTITION BY epoch_id ORDER BY p DESC NULLS LAST, document_id DESC, kind DESC, document_version_id DESC NULLS LAST) k FROM r),
d AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY epoch_id DESC) j FROM e WHERE k = 1)
SELECT document_id, document_version_id FROM d WHERE j = 1 AND kind <> 'delete' AND document_version_id IS NOT NULL"""
)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    state = live(current_versions(spark, folder), "kind")
    return state.filter("document_version_id is not null").select("document_id", "document_version_id")


@query(
    """WITH r AS (SELECT epoch_id, document_id, document_version_id, lower(trim(update_kind, ' \t\n\r')) kind, previous_published_epoch_id p FROM m4_update WHERE lower(trim(update_kind, ' \t\n\r')) IN ('insert', 'replace', 'delete') AND epoch_id IS NOT NULL AND document_id IS NOT NULL),
e AS (SELECT *, row_number() OVER (PARTITION BY epoch_id ORDER BY p DESC NULLS LAST, document_id DESC, kind DESC, document_version_id DESC NULLS LAST) k FROM r),
d AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY epoch_id DESC) j FROM e WHERE k = 1)
SELECT document_id, epoch_id AS deleted_at FROM d WHERE j = 1 AND kind = 'delete'"""
)
def p5_tombstones(spark: SparkSession, folder: str) -> DataFrame:
    """Documents deleted at the end, with the epoch before which late changes must stay without effect."""
    state = current_versions(spark, folder).filter("kind = 'delete'")
    return state.select("document_id", F.col("epoch_id").alias("deleted_at"))
