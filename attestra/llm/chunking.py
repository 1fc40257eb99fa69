"""Cutting oversized texts at natural boundaries by content-defined chunking.

A rolling hash runs over the text. From the last cut, the cut window lies between the least and the greatest piece
size; its landmark is the position with the least hash, and the cut snaps to the natural boundary nearest to the
landmark: a paragraph end if the window has one, else a sentence end, else a word end. A window without any takes the
last such end before it that the overlap allows; only where there is none, it takes the edge of a run of letters and
digits, or, inside an unbroken run, the landmark itself. Landmarks depend on the characters around them only, so after an edit the cuts fall back on
the old ones within a few pieces. Every piece after the first starts ``overlap`` characters before the cut.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters under the rolling hash.
WINDOW = 16
#: Least piece as a share of the greatest.
LEAST_SHARE = 0.5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUN = re.compile(r"[^\W_]+")
_PARAGRAPH = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_SENTENCE = re.compile(r"(?:[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？]+[」』）]*)\s*|\n")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\s+|[、，；：]|(?<=[^\W_])[-/,;:](?=[^\W_])")


def canonical_text(text: str) -> str:
    """CRLF and CR read as LF; no white space at the ends."""
    return text.replace("\r\n", "\n").replace("\r", "\n").strip()


def rolling_hash(text: str) -> np.ndarray:
    """For each position p in 0..n the hash of the WINDOW characters that end before p and of the one behind."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(codes)
    padded = np.concatenate([np.zeros(WINDOW, np.uint64), codes, np.zeros(1, np.uint64)])
    value = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW + 1):
            value = value * _BASE + padded[k : k + n + 1] + np.uint64(1)
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(32)
    return value


def _nearest(positions: np.ndarray, lo: int, hi: int, landmark: int) -> int | None:
    inside = positions[np.searchsorted(positions, lo) : np.searchsorted(positions, hi, "right")]
    return int(inside[np.argmin(np.abs(inside - landmark))]) if len(inside) else None


def _splits_character(text: str, p: int) -> bool:
    """Whether a cut before position p would part a combining mark, a joiner or a selector from its base."""
    return p < len(text) and (unicodedata.combining(text[p]) != 0 or text[p] in "\u200d\ufe0e\ufe0f" or text[p - 1] == "\u200d")


def cut_positions(text: str, greatest: int, overlap: int) -> list[int]:
    """Ascending cuts inside a canonical text; [] if it is within the limit."""
    n = len(text)
    if n <= greatest:
        return []
    hashes = rolling_hash(text)
    ends = [np.array(sorted({m.end() for m in p.finditer(text)} | {0}), dtype=np.int64) for p in (_PARAGRAPH, _SENTENCE, _WORD)]
    ends.append(np.array([m.start() for m in _SPACE.finditer(text)], dtype=np.int64))  # a word may end at the limit itself
    edges = np.array(sorted({p for m in _RUN.finditer(text) for p in m.span()}), dtype=np.int64)
    cuts: list[int] = []
    at = 0
    while n - at > greatest - (overlap if cuts else 0):
        room = greatest - (overlap if cuts else 0)
        hi = at + room
        lo = min(at + max(1, overlap + 1 if not cuts else 1, int(room * LEAST_SHARE)), hi)
        landmark = lo + int(np.argmin(hashes[lo : hi + 1]))
        first = at + (1 if cuts else overlap + 1)
        cut = next((c for e in ends if (c := _nearest(e, lo, hi, landmark)) is not None), None)
        if cut is None:  # the last end before the window, then any edge of a run
            cut = max((c for e in ends if (c := _nearest(e, first, lo - 1, lo - 1)) is not None), default=None)
        if cut is None:
            cut = next((c for low, high in ((lo, hi), (first, lo - 1)) if (c := _nearest(edges, low, high, min(landmark, high))) is not None), landmark)
        if _splits_character(text, cut):
            near = (p for d in range(hi - first + 1) for p in (cut - d, cut + d) if min(lo, cut) <= p <= hi)
            cut = next((p for p in near if not _splits_character(text, p)), cut)
        cuts.append(cut)
        at = cut
    return cuts


def pieces(text: str, greatest: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a canonical text: each at most ``greatest`` characters long, all but the
    first starting exactly ``overlap`` characters before the end of the one before."""
    cuts = cut_positions(text, greatest, overlap)
    starts = [0, *[c - overlap for c in cuts]]
    return list(zip(starts, [*cuts, len(text)]))


def longest_cut_run(text: str, cuts: list[int]) -> int:
    """Length of the longest run of letters and digits that a cut falls into; 0 if none does."""
    spans = [m.span() for m in _RUN.finditer(text)] if cuts else []
    starts = [a for a, _ in spans]
    inside = [spans[i] for c in cuts if (i := bisect.bisect_left(starts, c) - 1) >= 0 and c < spans[i][1]]
    return max((b - a for a, b in inside), default=0)


def _chunk(with_text: bool):
    names = ["key", "piece", "n_pieces", "start", "end", "over_limit", "no_boundary", "text"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    width = len(names) - (not with_text)

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * width
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[:width])

        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for key, raw, greatest, overlap in zip(*[batch[c].to_pylist() for c in ("key", "text", "greatest", "overlap")]):
                text = canonical_text(raw)
                spans = pieces(text, greatest, min(max(overlap or 0, 0), greatest - 1))
                unbroken = longest_cut_run(text, [e for _, e in spans[:-1]]) > greatest
                size += len(text)
                rows += [(key, i, len(spans), a, b, len(spans) > 1, unbroken, *((text[a:b],) if with_text else ())) for i, (a, b) in enumerate(spans)]
                if size > 1 << 22:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)

    return chunk


def chunk_texts(df: DataFrame, key: str, text: str, greatest: str, overlap: str, with_text: bool = True) -> DataFrame:
    """key, piece (0, 1, ...), n_pieces, start, end, over_limit, no_boundary and, if asked for, text of every piece.

    Positions count code points of the canonical text (LF line ends, no white space at the ends). A text within its
    limit is one piece, as is an empty or blank one (of no characters). Null texts and limits that are null or below
    1 give no rows; a null key stays a null key. An overlap that is null or negative counts as 0, one of the limit or more as
    the limit less 1. over_limit: the text was cut; no_boundary: a cut falls inside a run of letters and digits that is
    longer than the limit (any such run has one). Repeated rows give their pieces each time.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(greatest).cast("int").alias("greatest"), F.col(overlap).cast("int").alias("overlap"))
    rows = rows.filter(F.col("text").isNotNull() & (F.col("greatest") >= 1))
    schema = "key string, piece int, n_pieces int, start bigint, end bigint, over_limit boolean, no_boundary boolean" + (", text string" if with_text else "")
    return rows.withColumn("key", F.col("key").cast("string")).mapInArrow(_chunk(with_text), schema).withColumnRenamed("key", key)
