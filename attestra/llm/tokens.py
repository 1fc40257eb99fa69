"""Token ids of a whole corpus in a public byte-level BPE vocabulary.

The vocabulary's pre-tokenizer splits a text into stretches that are encoded one by one, so texts are cut at its
splits. What it leaves unsplit and long (a stretch of letters of any length) is encoded by tree concatenation: the
stretch is halved down to leaves, the leaves are encoded in parallel, and at each join a window around it is encoded
again, twice as wide each time, until its ids agree with those already there on both sides. Two neighbouring tokens
stand in the encoding of a stretch exactly if encoding the two together gives these two again; a window
agrees when this holds at both of its edges, and then the whole is the exact encoding.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie: a parameter of every operator, with this default.
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pre-tokenizer's pattern of byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a leaf of an unsplit stretch, and of a block that is encoded as a row of its own.
LEAF_BYTES, BLOCK_BYTES = 2048, 1 << 18


class Vocabulary:
    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.split = regex.compile(PATTERN)
        self._ok: dict[tuple[int, int], bool] = {}

    def piece(self, data: bytes) -> list[int]:
        """The ids of a stretch that the pre-tokenizer doesn't split."""
        return self.encoding._core_bpe.encode_single_piece(data) if data else []

    def fits(self, a: int, b: int) -> bool:
        """Whether ids a, b can follow each other inside a stretch."""
        key = (a, b)
        if key not in self._ok:
            if len(self._ok) > 1 << 20:
                self._ok.clear()
            self._ok[key] = self.piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self._ok[key]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of a stretch from those of its two parts."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        width = 2
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            middle = self.piece(b"".join(self.bytes_of[t] for t in left[i:] + right[:j]))
            if (i == 0 or self.fits(left[i - 1], middle[0])) and (j == len(right) or self.fits(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            width *= 2

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Joins neighbours, then neighbours of these, up to the root."""
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def stretch(self, data: bytes, leaf: int = LEAF_BYTES) -> list[int]:
        return self.piece(data) if len(data) <= leaf else self.join_all([self.piece(data[k : k + leaf]) for k in range(0, len(data), leaf)])

    def encode(self, text: str, leaf: int = LEAF_BYTES) -> list[int]:
        """The ids of a text; strings of special tokens in it are plain text."""
        if len(text) <= leaf // 4:
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        for begin, end, alone in self._spans(text, leaf // 4, len(text)):
            out += self.stretch(text[begin:end].encode("utf-8"), leaf) if alone else self.encoding.encode_ordinary(text[begin:end])
        return out

    def _spans(self, text: str, long: int, size: int) -> Iterator[tuple[int, int, bool]]:
        """(begin, end, whether it is one stretch): the text in spans that can be encoded on their own. Spans of
        several stretches have about ``size`` characters and end behind a character that isn't white space: the
        split of white space depends on what follows it, so white space that ends a span goes as single stretches."""
        begin = safe = 0
        tail: list[tuple[int, int, bool]] = []
        for m in self.split.finditer(text):
            end = m.end()
            if end - m.start() > long:
                if begin < safe:
                    yield begin, safe, False
                yield from tail
                yield m.start(), end, True
            elif text[end - 1].isspace():
                tail.append((m.start(), end, True))
                continue
            elif end - begin >= size:
                yield begin, end, False
            else:
                safe, tail = end, []
                continue
            begin, safe, tail = end, end, []
        if begin < len(text):
            yield begin, len(text), False

    def blocks(self, text: str, size: int) -> Iterator[tuple[bytes, bool, bool]]:
        """(bytes, part of one stretch, not its first part): the spans of a text, long stretches in parts of ``size`` bytes."""
        for begin, end, alone in self._spans(text, size, size):
            data = text[begin:end].encode("utf-8")
            for k in range(0, len(data), size if alone else len(data)):
                yield data[k : k + size] if alone else data, alone, k > 0


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary a Python process, read from the copy that came with the job, where there is one, else from ``path``."""
    shipped = SparkFiles.get(os.path.basename(path)) if SparkFiles._is_running_on_worker else path
    return Vocabulary(shipped if os.path.exists(shipped) else path)


def _ship(df: DataFrame, path: str) -> None:
    """Sends the vocabulary file with the job, so that no other machine needs one."""
    df.sparkSession.sparkContext.addFile(path)


def _encode_short(path: str, leaf: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            ids = [v.encode(t, leaf) if t else [] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return encode


_BLOCK = pa.schema(
    [("row", pa.int64()), ("id", pa.int64()), ("seq", pa.int32()), ("data", pa.binary()), ("stretch", pa.bool_()), ("inside", pa.bool_())]
)


def _split_long(path: str, block: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for row, key, text in zip(*[batch[c].to_pylist() for c in ("row", "id", "text")]):
                for seq, part in enumerate(v.blocks(text, block)):
                    yield pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, [row, key, seq, *part]))], schema=_BLOCK)

    return split


def _encode_blocks(path: str, leaf: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            ids = []
            for data, stretch in zip(batch["data"].to_pylist(), batch["stretch"].to_pylist()):
                ids.append(v.stretch(data, leaf) if stretch else v.encode(data.decode("utf-8"), leaf))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["id"], batch["seq"], batch["inside"], pa.array(ids, pa.list_(pa.int32()))], ["row", "id", "seq", "inside", "ids"]
            )

    return encode


def _join_blocks(path: str):
    def join(batch: pa.Table) -> pa.Table:
        v = vocabulary(path)
        out: list[int] = []
        open_stretch: list[list[int]] = []
        for _, inside, ids in sorted(zip(*[batch[c].to_pylist() for c in ("seq", "inside", "ids")])):
            if not inside:
                out += v.join_all(open_stretch)
                open_stretch = []
            open_stretch.append(ids)
        out += v.join_all(open_stretch)
        return pa.table({"id": batch["id"].slice(0, 1), "ids": pa.array([out], pa.list_(pa.int32()))})

    return join


def encode_texts(df: DataFrame, key: str, text: str, path: str = VOCABULARY, leaf: int = LEAF_BYTES, block: int = BLOCK_BYTES, length: str | None = None) -> DataFrame:
    """key (bigint) and ids (array<int>), one row for each row of ``df``.

    ids is [] for an empty and for a null text. Texts of up to ``block`` code points are encoded where they are read;
    longer ones are cut into blocks that are encoded in parallel and joined again. ``length`` may name a column with the
    texts' lengths: the scan for long texts then skips all pages that have none. It only decides which way a text goes, and both
    give the same ids, so a wrong or null length does no harm. Repeated rows and keys, null keys among them, give a row
    each. Extra columns are ignored.
    """
    _ship(df, path)
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), (F.col(length) if length else F.char_length(text)).alias("__length"))
    long = (F.col("__length") > block) & (F.col("text") != "")
    short = rows.filter(~F.coalesce(long, F.lit(False))).select("id", "text").mapInArrow(_encode_short(path, leaf), "id bigint, ids array<int>")
    parts = rows.filter(long).select("id", "text").withColumn("row", F.monotonically_increasing_id())
    parts = parts.mapInArrow(_split_long(path, block), "row bigint, id bigint, seq int, data binary, stretch boolean, inside boolean")
    coded = parts.repartition("row", "seq").mapInArrow(_encode_blocks(path, leaf), "row bigint, id bigint, seq int, inside boolean, ids array<int>")
    joined = coded.groupBy("row").applyInArrow(_join_blocks(path), "id bigint, ids array<int>")
    return short.unionByName(joined).withColumnRenamed("id", key)


def count_tokens(df: DataFrame, text: str, path: str = VOCABULARY, leaf: int = LEAF_BYTES) -> DataFrame:
    """``df`` without ``text``, and tokens (int): the number of its ids, 0 for an empty and for a null text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            n = [len(v.encode(t, leaf)) if t else 0 for t in batch["__text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch[i] for i in range(batch.num_columns - 1)], pa.array(n, pa.int32())], [*batch.schema.names[:-1], "tokens"])

    _ship(df, path)
    rows = df.select(*[c for c in df.columns if c not in (text, "tokens")], F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(count, ", ".join(x for x in (fields, "tokens int") if x))
