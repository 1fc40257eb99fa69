"""The plain chunker: paragraphs packed into chunks of bounded length."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Fixed value: what separates paragraphs: a line end and at least one line of blanks.
BLANK_LINES = re.compile(r"\n(?:[ \t\f\v]*\n)+")


def split_long(paragraph: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters, cut at the last white space that stands within them, else behind the last character."""
    out, rest = [], paragraph
    while len(rest) > most:
        at = next((i for i in range(most - 1, 0, -1) if rest[i].isspace()), most)
        piece = rest[:at].rstrip()
        out.append(piece or rest[:most])
        rest = rest[at if piece else most :].lstrip()
    return [*out, rest] if rest else out


def pack(text: str, most: int) -> list[str]:
    """Chunks of whole paragraphs joined by one blank line. A paragraph longer than a chunk ends the chunk before it, and its pieces are chunks of their own."""
    paragraphs = [p for part in BLANK_LINES.split(text.replace("\r\n", "\n").replace("\r", "\n").strip()) if (p := part.strip())]
    chunks: list[str] = []
    packing = False
    for paragraph in paragraphs:
        if len(paragraph) > most:
            chunks += split_long(paragraph, most)
            packing = False
        elif packing and len(chunks[-1]) + 2 + len(paragraph) <= most:
            chunks[-1] += "\n\n" + paragraph
        else:
            chunks.append(paragraph)
            packing = True
    return chunks


def paragraph_chunks(df: DataFrame, key: str, text: str, most: int = 1200) -> DataFrame:
    """key, chunk_index, chunk: chunks of every text; null and blank texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = [pack(t, most) for t in batch["t"].to_pylist()]
            rows = [i for i, c in enumerate(chunks) for _ in c]
            index = [j for c in chunks for j in range(len(c))]
            columns = [batch["k"].take(pa.array(rows, pa.int64())), pa.array(index, pa.int32()), pa.array([x for c in chunks for x in c], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "chunk_index", "chunk"])

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null")
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, chunk_index int, chunk string").withColumnRenamed("k", key)


def evidence_units(sentences: DataFrame, key: str, index: str, text: str, most: int = 1200) -> DataFrame:
    """key, unit (JSON array of the different sentences in order), reason: empty, too_long or null for a good unit."""
    rows = sentences.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(index, text))).alias("s"))
    lines = F.transform("s", lambda x: x[text])
    length = F.char_length(F.array_join(lines, " "))
    empty = F.exists(lines, lambda x: x.isNull() | (F.trim(x) == "")) | (F.size("s") == 0)
    return rows.select(key, F.to_json(lines).alias("unit"), F.when(empty, "empty").when(length > most, "too_long").alias("reason"))
