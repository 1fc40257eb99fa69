"""Length-framed SHA-256 digests as JVM expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def framed(field: Column) -> Column:
    """The UTF-8 bytes of a field behind their length as eight big-endian bytes."""
    data = F.encode(field, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data).cast("bigint")), 16, "0")), data)


def digest(*fields: Column) -> Column:
    """Hex SHA-256 over framed fields; a null field gives null, so absent values need an explicit marker."""
    return F.sha2(F.concat(*[framed(f) for f in fields]), 256)


def digest_of_sorted(items: Column) -> Column:
    """Order-free digest of an array of strings."""
    frames = F.transform(
        F.sort_array(items), lambda x: F.concat(F.lpad(F.hex(F.octet_length(F.encode(x, "UTF-8")).cast("bigint")), 16, "0"), F.hex(F.encode(x, "UTF-8")))
    )
    return F.sha2(F.unhex(F.array_join(frames, "")), 256)


@F.pandas_udf(T.StringType())
def f64_hex(value: pd.Series) -> pd.Series:
    """The 16 hex digits of a double's IEEE-754 bytes, big-endian; null for null. A value that is not finite is an error."""
    known = value.notna().to_numpy()
    numbers = value.to_numpy(dtype=np.float64, na_value=0.0)
    if not np.isfinite(numbers[known]).all():
        raise ValueError("digest fields must be finite numbers")
    text = numbers.astype(">f8").tobytes().hex()
    return pd.Series([text[16 * i : 16 * i + 16] if k else None for i, k in enumerate(known)])


def typed_fields(*fields: tuple[str, Column]) -> Column:
    """The fields as an array of type names and texts, so that equal texts of different types have different digests. Kinds: str, int,
    bool, f64; a null value of any kind becomes the single field null."""
    text = {"str": lambda c: c, "int": lambda c: c.cast("bigint").cast("string"), "bool": lambda c: F.when(c, "true").otherwise("false"), "f64": f64_hex}
    parts = [F.when(c.isNull(), F.array(F.lit("null"))).otherwise(F.array(F.lit(kind), text[kind](c))) for kind, c in fields]
    return F.flatten(F.array(*parts))


def digest_of(fields: Column) -> Column:
    """Hex SHA-256 over the framed members of an array of strings, in their order."""
    frames = F.transform(fields, lambda x: F.concat(F.lpad(F.hex(F.octet_length(F.encode(x, "UTF-8")).cast("bigint")), 16, "0"), F.hex(F.encode(x, "UTF-8"))))
    return F.sha2(F.unhex(F.array_join(frames, "")), 256)


def hash_draw(modulus: Column, *fields: Column) -> Column:
    """An integer in [0, modulus) from the first 16 hex digits of a digest: the portable random draw."""
    head = F.conv(F.substring(F.sha2(F.concat_ws("\u0000", *fields), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % modulus.cast("decimal(20,0)")).cast("bigint")
