"""Stand-ins for models: deterministic vectors and verdicts from hashes, and softmax expressions for real logits."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hash_vector(text: str, dimension: int) -> np.ndarray:
    """A unit vector that depends on nothing but the text."""
    bytes_needed = dimension * 4
    blocks = [hashlib.sha256(f"{i}\0{text}".encode()).digest() for i in range(-(-bytes_needed // 32))]
    raw = np.frombuffer(b"".join(blocks)[:bytes_needed], ">u4").astype(np.float64) / 2**31 - 1.0
    return raw / np.sqrt((raw * raw).sum())


def embed(dimension: int = 384):
    """A pandas UDF from texts to unit vectors; null texts have null vectors."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hash_vector(t, dimension).tolist())

    return run


def softmax(logits: list[Column], temperature: float = 1.0) -> list[Column]:
    """Probabilities of logits at a temperature, shifted by the greatest so that nothing overflows."""
    top = F.greatest(*logits)
    powers = [F.exp((x - top) / F.lit(temperature)) for x in logits]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_logits(claim: pd.Series, evidence: pd.Series) -> pd.Series:
    """Three logits in [-4, 4) from a hash of the pair; null if a side is null."""

    def one(a: str | None, b: str | None) -> list[float] | None:
        if a is None or b is None:
            return None
        h = hashlib.sha256(f"{a}\0{b}".encode()).digest()
        return [int.from_bytes(h[8 * i : 8 * i + 8], "big") / 2**61 - 4.0 for i in range(3)]

    return pd.Series([one(a, b) for a, b in zip(claim, evidence)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; null where a side is null, of another length or of norm 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(norm, F.lit(0.0))))
    return F.when(F.size(a) == F.size(b), value)
