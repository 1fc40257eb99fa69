"""Labels and statuses as column expressions. Scores that are null or NaN never reach a threshold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _score(name: str | Column) -> Column:
    value = F.col(name) if isinstance(name, str) else name
    return F.nanvl(value, F.lit(None).cast("double"))


def decide(s: str | Column, r: str | Column, n: str | Column, support: float, refute: float) -> Column:
    """Tie rule v1: refute wins ties, support must lead strictly."""
    s, r, n = _score(s), _score(r), _score(n)
    return (
        F.when((r >= F.lit(refute)) & (r >= s) & (r >= n), "refute")
        .when((s >= F.lit(support)) & (s > r) & (s > n), "support")
        .otherwise("neutral")
    )


def potential_partition(s: str | Column, r: str | Column, n: str | Column) -> Column:
    """What a triple can become at any threshold."""
    s, r, n = _score(s), _score(r), _score(n)
    return F.when((s > r) & (s > n), "support_capable").when((r >= s) & (r >= n), "refute_capable").otherwise("always_neutral")


def argmax_label(s: str | Column, r: str | Column, n: str | Column) -> Column:
    """The first greatest score in the order support, refute, neutral; null if all are null."""
    s, r, n = _score(s), _score(r), _score(n)
    top = F.greatest(s, r, n)
    return F.when(s == top, "support").when(r == top, "refute").when(n == top, "neutral")


def claim_status(supports: str | Column, refutes: str | Column) -> Column:
    supports, refutes = (F.col(x) if isinstance(x, str) else x for x in (supports, refutes))
    return (
        F.when((supports > 0) & (refutes > 0), "conflicted").when(supports > 0, "supported").when(refutes > 0, "refuted").otherwise("unsupported")
    )


def answer_status(required: Column, supported: Column, refuted: Column, conflicted: Column) -> Column:
    return (
        F.when(refuted > 0, "contradicted")
        .when(conflicted > 0, "conflicted")
        .when((required > 0) & (supported == required), "valid")
        .when(supported > 0, "partially_supported")
        .otherwise("unsupported")
    )
