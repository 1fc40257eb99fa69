"""Keyed maintenance: applies a batch of events to published tables and recomputes only what they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policy import decide
from ..session import materialize
from ..sources.store import Store
from . import claims as C
from . import deltas as D
from . import temporal as T

CHUNKS = "chunk_id string, document_id string, text_hash string, valid_from bigint, valid_to bigint"
OBSERVATIONS = "claim_id string, chunk_id string, seq bigint, observation_id string, s double, r double, n double"
POLICY = "support double, refute double"
_KEY, _ORDER = ["claim_id", "chunk_id"], ["seq", "observation_id"]


class Engine:
    """Claim and answer states under events, each batch of which becomes one version of the store.

    A version writes the changed rows of chunk, currency, state and answer only. Chunk ids are never used again; an insert of a known one
    replaces it. Tables: chunk (with validity), currency (latest observation of each claim and chunk), policy (one row), state, answer and delta
    (status changes of the version). An applied version is not applied again. Observations on chunks that are not valid are
    stored and count as soon as such a chunk is inserted, not before.
    """

    def __init__(self, spark: SparkSession, store: Store, claims: DataFrame):
        self.spark, self.store, self.claims = spark, store, claims

    def start(self, support: float, refute: float) -> None:
        empty = {"chunk": self.spark.createDataFrame([], CHUNKS), "currency": self.spark.createDataFrame([], OBSERVATIONS)}
        empty["policy"] = self.spark.createDataFrame([(support, refute)], POLICY)
        self.store.publish(0, empty | self._states(self._rows(empty["chunk"], empty["currency"]), (support, refute), self.claims))

    def _policy(self) -> tuple[float, float]:
        return tuple(self.store.read("policy").first())

    @staticmethod
    def _rows(chunks: DataFrame, currency: DataFrame) -> DataFrame:
        """Current observations on valid chunks."""
        return currency.join(chunks.filter("valid_to is null").select("chunk_id", "text_hash"), "chunk_id")

    def _states(self, rows: DataFrame, policy: tuple[float, float], claims: DataFrame) -> dict[str, DataFrame]:
        states = C.claim_states(claims, rows.withColumn("label", decide("s", "r", "n", *policy)))
        return {"state": states, "answer": C.answer_states(states)}

    def apply(self, version: int, inserted: DataFrame | None = None, deleted: DataFrame | None = None, observed: DataFrame | None = None, policy: tuple[float, float] | None = None) -> bool:
        """Whether the version is new. inserted: chunk_id, document_id, text_hash of documents that replace what they had; deleted:
        document_id; observed: OBSERVATIONS; policy: new thresholds."""
        head = self.store.head()
        if head is not None and version <= head:
            return False
        old_chunks, old_currency, old_policy = self.store.read("chunk"), self.store.read("currency"), self._policy()
        old_states, old_answers = self.store.read("state"), self.store.read("answer")
        inserted = (self.spark.createDataFrame([], CHUNKS) if inserted is None else inserted).select("chunk_id", "document_id", "text_hash").distinct()
        gone = inserted.select("document_id") if deleted is None else inserted.select("document_id").unionByName(deleted.select("document_id"))
        observed = self.spark.createDataFrame([], OBSERVATIONS) if observed is None else observed
        policy = policy or old_policy

        closing = old_chunks.filter("valid_to is null").join(gone.distinct(), "document_id", "left_semi")
        closed = closing.withColumn("valid_to", F.lit(version).cast("bigint"))
        fresh = inserted.withColumn("valid_from", F.lit(version).cast("bigint")).withColumn("valid_to", F.lit(None).cast("bigint"))
        changed_chunks = closed.unionByName(fresh)
        chunks = T.overlay(old_chunks, changed_chunks, ["chunk_id"], F.lit(False))
        same_keys = old_currency.join(observed.select(*_KEY).distinct(), _KEY, "left_semi")
        changed_currency = materialize(T.latest(same_keys.unionByName(observed.select(*old_currency.columns)), _KEY, _ORDER))
        currency = T.overlay(old_currency, changed_currency, _KEY, F.lit(False))

        touched = changed_chunks.select("chunk_id").distinct()
        dirty = observed.select("claim_id").unionByName(currency.join(touched, "chunk_id", "left_semi").select("claim_id"))
        if policy != old_policy:
            dirty = dirty.unionByName(D.flips_by_partition(self._rows(chunks, currency), old_policy, policy).select("claim_id"))
        dirty = materialize(dirty.distinct())

        claims = self.claims.join(dirty, "claim_id", "left_semi")
        again = materialize(self._states(self._rows(chunks, currency.join(dirty, "claim_id", "left_semi")), policy, claims)["state"])
        before = old_states.join(dirty, "claim_id", "left_semi")
        moved = C.status_deltas(before, again, "claim_id", "claim")
        # an answer is touched only if the status of a required claim of it has changed
        changed = moved.select(F.col("object_id").alias("claim_id")).join(self.claims.filter("required"), "claim_id").select("answer_id").distinct()
        states = T.overlay(old_states.join(changed, "answer_id", "left_semi"), again.join(changed, "answer_id", "left_semi"), ["claim_id"], F.lit(False))
        answers = C.answer_states(states)
        deltas = moved.unionByName(C.status_deltas(old_answers.join(changed, "answer_id", "left_semi"), answers, "answer_id", "answer"))
        whole = {"delta": deltas} | ({} if policy == old_policy else {"policy": self.spark.createDataFrame([policy], POLICY)})
        changes = {"chunk": (changed_chunks, ["chunk_id"]), "currency": (changed_currency, _KEY), "state": (again, ["claim_id"]), "answer": (answers, ["answer_id"])}
        return self.store.publish(version, whole, changes=changes)

    def mismatches(self) -> int:
        """Rows in which the maintained tables differ from a full recompute."""
        full = self._states(self._rows(self.store.read("chunk"), self.store.read("currency")), self._policy(), self.claims)
        states = C.differences(self.store.read("state"), full["state"], "claim_id", C.STATE)
        counts = [f"{x}_count" for x in ("required", "supported", "refuted", "conflicted", "unsupported")]
        return states.count() + C.differences(self.store.read("answer"), full["answer"], "answer_id", [*counts, "status"]).count()
