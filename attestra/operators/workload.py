"""Seeded workloads for tests and benchmarks, made on the driver in sizes that fit it."""

from __future__ import annotations

import random
from collections.abc import Iterator


def skewed_choice(rng: random.Random, population: int, count: int, skew: float) -> list[int]:
    """``count`` different numbers below ``population``, number i drawn with weight 1 / (i + 1) ** skew."""
    keys = sorted((rng.expovariate(1.0) * (i + 1) ** skew, i) for i in range(population))
    return [i for _, i in keys[:count]]


def event_stream(seed: int, length: int, documents: int = 3, claims: int = 3, texts: int = 4) -> Iterator[tuple]:
    """Events (number, kind, document, text, claim, scores): insert, delete, replace, observe and policy, with repeated texts."""
    rng = random.Random(seed)
    active: set[int] = set()
    for number in range(length):
        kinds = ["observe", "observe", "policy", *(["insert"] if len(active) < documents else []), *(["delete", "replace"] if active else [])]
        kind = rng.choice(kinds)
        document = claim = text = scores = None
        if kind == "insert":
            document = rng.choice(sorted(set(range(documents)) - active))
            active.add(document)
        elif kind in ("delete", "replace"):
            document = rng.choice(sorted(active))
            active -= {document} if kind == "delete" else set()
        if kind in ("insert", "replace"):
            text = rng.randrange(texts)
        if kind == "observe":
            document, claim = rng.randrange(documents), rng.randrange(claims)
            scores = tuple(rng.choice([(0.9, 0.05, 0.05), (0.05, 0.9, 0.05), (0.1, 0.1, 0.8), (0.7, 0.2, 0.1)]))
        if kind == "policy":
            scores = (rng.choice([0.25, 0.5, 0.7, 0.8, 0.9]), rng.choice([0.25, 0.5, 0.7, 0.8, 0.9]))
        yield number, kind, document, text, claim, scores
