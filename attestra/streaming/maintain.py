"""Claim states under a stream of observations."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.changefeed import fold_changes
from ..sources.store import Store


def fold_stream(stream: DataFrame, store: Store, name: str, key: list[str], order: list[str], op: str, payload: list[str], checkpoint: str, **options: str) -> StreamingQuery:
    """Keeps table ``name`` of the store equal to the fold of all changes the stream has brought.

    Each micro-batch is folded with the published state, tombstones included, and published as the next version. A batch that is
    run again after a failure is recognised by its number, and since the fold is idempotent nothing depends on that.
    """

    def apply(batch: DataFrame, number: int) -> None:
        head = store.head()
        base = store.read(name) if head is not None else None
        store.publish(number, {name: fold_changes(batch, key, order, op, payload, base)})

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).options(**options).start()


def _status(counts: dict[str, dict[str, int]]) -> str:
    support, refute = bool(counts["support"]), bool(counts["refute"])
    return "conflicted" if support and refute else "supported" if support else "refuted" if refute else "unsupported"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    counts = json.loads(state.get[0]) if state.exists else {"support": {}, "refute": {}}
    before = _status(counts)
    for rows in batches:
        for label, text_hash, delta in zip(rows["label"], rows["text_hash"], rows["delta"]):
            if label in counts:
                n = counts[label].get(text_hash, 0) + int(delta)
                if n < 0:
                    raise ValueError(f"claim {key[0]}: more withdrawals than contributions of {text_hash}")
                counts[label].pop(text_hash, None)
                if n:
                    counts[label][text_hash] = n
    state.update((json.dumps(counts),))
    after = _status(counts)
    if before != after:
        yield pd.DataFrame({"claim_id": [key[0]], "old_status": [before], "new_status": [after], "support_count": [len(counts["support"])], "refute_count": [len(counts["refute"])]})


def status_stream(contributions: DataFrame) -> DataFrame:
    """Status changes of claims under a stream of signed contributions (claim_id, label, text_hash, delta).

    State is kept by claim: reference counts of its text hashes. Only a change of status is emitted; neutral contributions and those on
    inactive chunks (which bring no delta) leave the state as it is.
    """
    kind = contributions.schema["claim_id"].dataType.simpleString()
    return contributions.groupBy("claim_id").applyInPandasWithState(
        _advance,
        f"claim_id {kind}, old_status string, new_status string, support_count bigint, refute_count bigint",
        "counts string",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def run_to_end(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a streaming frame over all available input, handing each result batch to ``each``."""
    query = df.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
