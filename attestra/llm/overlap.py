"""Records of evaluation splits that also stand, exactly or almost, in the training split.

Records are canonicalised (case, Unicode form, invisible characters, punctuation, white space, markup) and hashed;
rows with equal hashes form one class, and all further work is on one row a class, so copies are never expanded
before the result. Words travel as 64-bit hashes from the first step on; no text leaves the scan. Evaluation hashes meet training hashes in two equi-joins:

* exact: the class hash over the sorted words of both texts;
* almost: hashes of single words. Two texts that share at least 3/4 of the longer one's words (with repeats, in any
  order) share a word among the first ``n - ceil(3n/4) + 1`` of each in any fixed order of words, so joining the
  hashes of these words misses no pair. The order puts frequent words last. Word hashes that are still frequent are
  joined together with a word of the other text, which must agree as well. Bitmaps of both texts travel with
  the hashes and bound the shared words from above inside the join; what is left is counted on the hashed words.
"""

from __future__ import annotations

import hashlib
import html
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from ..session import materialize

#: Inline elements, whose tags stand inside or around a word; other tags separate words.
INLINE_TAGS = ("a", "abbr", "b", "big", "code", "del", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "tt", "u", "var")
#: Spellings of the splits (folded) and their names.
SPLITS = {"train": "train", "development": "development", "dev": "development", "test": "test", "transfer": "transfer"}

_INVISIBLE = re.compile(
    "[" + "".join(re.escape(chr(i)) for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Cf") + r"\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180d\u3164\ufe00-\ufe0f\uffa0\U000e0100-\U000e01ef]"
)
_INLINE = re.compile(rf"</?(?:{'|'.join(INLINE_TAGS)})(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_LINK = re.compile(r"\]\([^()\s]*\)")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The runs of letters and digits of a text after undoing case, Unicode form, invisible characters and markup."""
    if "&" in text:
        text = html.unescape(text)
    plain = text.isascii()
    if not plain:
        text = unicodedata.normalize("NFKC", text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "](" in text:
        text = _LINK.sub("]", text)
    if plain:
        return _WORD.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFKC", _INVISIBLE.sub("", text).casefold()))


def _numbered(text: str) -> Iterator[str]:
    seen: dict[str, int] = {}
    for word in words(text):
        seen[word] = k = seen.get(word, 0) + 1
        yield word if k == 1 else f"{word}\t{k}"


def elements(text: str) -> list[str]:
    """The words as a set: the k-th repeat of a word is an element of its own."""
    return sorted(_numbered(text))


def shares_enough(a: list[str], b: list[str], share: float) -> bool:
    """Whether at least ``share`` of the longer list of elements is shared: the exact rule, used by brute force."""
    return len(set(a) & set(b)) >= share * max(len(a), len(b)) > 0


def _hashed(text: str, known: dict[str, int]) -> list[int]:
    """The elements of a text as ascending 64-bit hashes; ``known`` keeps the hashes of words."""
    out = []
    for word in _numbered(text):
        h = known.get(word)
        if h is None:
            h = known[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)
        out.append(h)
    out.sort()
    return out


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        if len(known) > 1 << 20:
            known.clear()
        claims = [_hashed(t, known) for t in batch["claim"].to_pylist()]
        evidence = [_hashed(t, known) for t in batch["evidence"].to_pylist()]
        claims, evidence = pa.array(claims, pa.list_(pa.int64())), pa.array(evidence, pa.list_(pa.int64()))
        a, b = claims.flatten().to_numpy(), evidence.flatten().to_numpy()
        at, bt = claims.offsets.to_pylist(), evidence.offsets.to_pylist()
        hashes = [hashlib.md5((at[i + 1] - at[i]).to_bytes(8) + a[at[i] : at[i + 1]].tobytes() + b[bt[i] : bt[i + 1]].tobytes()).digest() for i in range(len(batch))]
        yield pa.RecordBatch.from_arrays([batch["example_id"], batch["source"], batch["split"], pa.array(hashes, pa.binary()), claims, evidence], _RECORD)


_RECORD = ["example_id", "source", "split", "hash", "claim", "evidence"]


def canonical_records(examples: DataFrame) -> DataFrame:
    """example_id, source (folded), split (train, development, test, transfer), hash, claim and evidence as hashed elements.

    Rows of no known split, with a null id, or with a claim or evidence that is null or holds no word take no part.
    A row delivered again stays a row of its own. Extra columns are ignored.
    """
    names = F.create_map(*[F.lit(x) for pair in SPLITS.items() for x in pair])
    rows = examples.select(
        "example_id", fold(F.col("source")).alias("source"), F.element_at(names, fold(F.col("split"))).alias("split"), "claim", "evidence"
    ).dropna(subset=["example_id", "split", "claim", "evidence"])
    out = rows.mapInArrow(_canonical, "example_id string, source string, split string, hash binary, claim array<bigint>, evidence array<bigint>")
    return out.filter((F.size("claim") > 0) & (F.size("evidence") > 0))


def _least_shared(n: int, share: float) -> int:
    return int(np.ceil(share * n - 1e-9))


def _prefix(hashes: list[int], frequent: dict[int, int], share: float) -> list[int]:
    order = sorted(hashes, key=lambda h: (frequent.get(h, 0), h))
    return order[: len(hashes) - _least_shared(len(hashes), share) + 1]


def _bitmaps(column: pa.Array, width: int) -> np.ndarray:
    """``width`` words of 64 bits for each row, in which the bits of its hashes are set."""
    values, lengths = column.flatten().to_numpy(), column.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros((len(lengths), width), np.uint64)
    np.bitwise_or.at(out, (row, (values >> 6) % width), np.uint64(1) << (values & 63).astype(np.uint64))
    return out.view(np.int64)


def _signatures(frequent_claim: dict[int, int], frequent_evidence: dict[int, int], share: float):
    """Hashes of the prefix words of both texts and a bitmap of all words of each (64 and 192 bits)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [batch[c] for c in ("cid", "train", "eval", "n_claim", "n_evidence")]
            arrays = [pa.array([_prefix(h, f, share) for h in batch[c].to_pylist()], pa.list_(pa.int64())) for c, f in (("claim", frequent_claim), ("evidence", frequent_evidence))]
            a, b = _bitmaps(batch["claim"], 1), _bitmaps(batch["evidence"], 3)
            columns = [pa.array(np.ascontiguousarray(x)) for x in (a[:, 0], b[:, 0], b[:, 1], b[:, 2])]
            yield pa.RecordBatch.from_arrays([*same, *arrays, *columns], _SIGNATURE)

    return rows


_SIGNATURE = ["cid", "train", "eval", "n_claim", "n_evidence", "claim_keys", "evidence_keys", "b0", "b1", "b2", "b3"]
_SIGNATURE_TYPE = (
    "cid bigint, train boolean, eval boolean, n_claim int, n_evidence int, claim_keys array<bigint>, evidence_keys array<bigint>, b0 bigint, b1 bigint, b2 bigint, b3 bigint"
)


def _most_frequent(df: DataFrame, column: Column, tracked: int, least: int) -> dict:
    """Values of ``column`` counted over all rows with one mergeable sketch of bounded size, those of at least
    ``least``. The sketch finds every value with more than rows/tracked occurrences or so."""
    top = df.agg(F.call_function("approx_top_k", column, F.lit(tracked // 4), F.lit(tracked)).alias("top")).first()["top"]
    return {x["item"]: x["count"] for x in top or [] if x["count"] >= least}


def _bound(n: str, bitmaps: list[str]) -> Column:
    """Most elements that can be shared: those of t whose bit is set in e's bitmap, and the other way round."""

    def one(a: str, b: str) -> Column:
        missing = sum((F.bit_count(F.col(f"{a}.{x}").bitwiseAND(F.bitwise_not(F.col(f"{b}.{x}")))) for x in bitmaps), F.lit(0))
        return F.col(f"{a}.{n}") - missing

    return F.least(one("t", "e"), one("e", "t"))


def cross_split_classes(records: DataFrame, share: float = 0.75, tracked: int = 65536, hot_rows: int = 256) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the canonical ``records``.

    members: cid, example_id, source, split, one row a record. links: t_cid, e_cid, each pair of a class with
    training records and a class with evaluation records that shares enough words (t_cid = e_cid: the same record).
    tracked: size of the sketches that order the words and find hot word hashes; results don't depend on it.
    hot_rows: word hashes in at least so many classes are joined together with a word of the claim.
    """
    classes = records.groupBy("hash").agg(
        F.any_value("claim").alias("claim"),
        F.any_value("evidence").alias("evidence"),
        F.bool_or(F.col("split") == "train").alias("train"),
        F.bool_or(F.col("split") != "train").alias("eval"),
    )
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    members = records.select("hash", "example_id", "source", "split").join(classes.select("hash", "cid"), "hash").drop("hash")

    frequent_evidence = _most_frequent(classes.select(F.explode("evidence").alias("x")), F.col("x"), tracked, 64)
    frequent_claim = _most_frequent(classes.select(F.explode("claim").alias("x")), F.col("x"), tracked, 64)
    texts = classes.select("cid", "train", "eval", F.size("claim").alias("n_claim"), F.size("evidence").alias("n_evidence"), "claim", "evidence")
    signatures = materialize(texts.mapInArrow(_signatures(frequent_claim, frequent_evidence, share), _SIGNATURE_TYPE))
    words_in = signatures.withColumn("word", F.explode("evidence_keys")).drop("evidence_keys")
    often = _most_frequent(words_in.select("word"), F.col("word"), tracked, hot_rows)
    hot = F.broadcast(signatures.sparkSession.createDataFrame([(k,) for k in often], "hot bigint"))  # at most tracked / 4 rows
    single = F.when(F.col("hot").isNull(), F.array("word")).otherwise(F.transform("claim_keys", lambda c: F.xxhash64("word", c)))
    keyed = words_in.join(hot, F.col("word") == F.col("hot"), "left").withColumn("key", F.explode(single)).drop("word", "hot", "claim_keys")

    t, e = keyed.filter("train").alias("t"), keyed.filter("eval").alias("e")
    enough = F.col("t.cid") != F.col("e.cid")
    for n, bitmaps in (("n_claim", ["b0"]), ("n_evidence", ["b1", "b2", "b3"])):
        needed = F.greatest(f"t.{n}", f"e.{n}") * F.lit(share) - F.lit(1e-9)
        enough = enough & (F.least(f"t.{n}", f"e.{n}") >= needed) & (_bound(n, bitmaps) >= needed)
    candidates = t.join(e, (F.col("t.key") == F.col("e.key")) & enough).select(F.col("t.cid").alias("t_cid"), F.col("e.cid").alias("e_cid")).distinct()

    a = classes.select(F.col("cid").alias("t_cid"), F.col("claim").alias("t_claim"), F.col("evidence").alias("t_evidence"))
    b = classes.select(F.col("cid").alias("e_cid"), F.col("claim").alias("e_claim"), F.col("evidence").alias("e_evidence"))
    near = candidates.join(a, "t_cid").join(b, "e_cid")
    for name in ("claim", "evidence"):
        shared = F.size(F.array_intersect(f"t_{name}", f"e_{name}"))
        near = near.filter(shared >= F.greatest(F.size(f"t_{name}"), F.size(f"e_{name}")) * F.lit(share) - F.lit(1e-9))
    same = classes.filter(F.col("train") & F.col("eval")).select(F.col("cid").alias("t_cid"), F.col("cid").alias("e_cid"))
    return members, near.select("t_cid", "e_cid").unionByName(same)


def overlap_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """example_id_a < example_id_b: every pair of a training and an evaluation record of linked classes, once."""
    train = members.filter(F.col("split") == "train").select(F.col("cid").alias("t_cid"), F.col("example_id").alias("t"))
    rest = members.filter(F.col("split") != "train").select(F.col("cid").alias("e_cid"), F.col("example_id").alias("e"))
    pairs = links.join(train, "t_cid").join(rest, "e_cid").filter(F.col("t") != F.col("e"))
    return pairs.select(F.least("t", "e").alias("example_id_a"), F.greatest("t", "e").alias("example_id_b")).distinct()


def overlap_by_record(members: DataFrame, links: DataFrame) -> DataFrame:
    """example_id, split, source, cid and links (training records of linked classes) of every evaluation record."""
    sizes = members.filter(F.col("split") == "train").groupBy(F.col("cid").alias("t_cid")).agg(F.count_distinct("example_id").alias("n"))
    linked = links.join(sizes, "t_cid").groupBy(F.col("e_cid").alias("cid")).agg(F.sum("n").alias("links"))
    rest = members.filter(F.col("split") != "train").select("example_id", "split", "source", "cid").distinct()
    return rest.join(linked, "cid", "left").withColumn("links", F.coalesce("links", F.lit(0)))


def overlap_report(members: DataFrame, links: DataFrame) -> DataFrame:
    """Per split and source: records, overlapping records, linked training records. A null source is a group of its own."""
    return overlap_by_record(members, links).groupBy("split", "source").agg(
        F.count_distinct("example_id").alias("records"),
        F.count_distinct(F.when(F.col("links") > 0, F.col("example_id"))).alias("overlapping"),
        F.sum("links").alias("training_links"),
    )
