"""Files of a pinned revision of a git repository as documents."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_REVISION = re.compile(r"[0-9a-f]{40}")


def _git(repository: str, *arguments: str) -> bytes:
    return subprocess.run(["git", "-C", repository, *arguments], check=True, capture_output=True).stdout


def read_revision(spark: SparkSession, repository: str, revision: str, folder: str = "", parts: int = 8) -> DataFrame:
    """path, revision, text of every file below ``folder`` as the revision has it; bytes that are not UTF-8 become replacement characters.

    The revision is pinned by its full hash; a name that can move is an error. Only the list of paths passes the driver; contents are
    read by the tasks from the repository, which all machines must be able to reach. Symbolic links and submodules are left out.
    """
    if not _REVISION.fullmatch(revision):
        raise ValueError("a pinned revision is the full hash of a commit")
    listed = _git(repository, "ls-tree", "-r", "-z", revision, *([folder] if folder else [])).decode("utf-8", "surrogateescape").split("\0")
    rows = [(name, entry.split()[2]) for line in listed if line for entry, name in [line.split("\t", 1)] if entry.split()[0] in ("100644", "100755")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, blob in zip(batch["path"].to_pylist(), batch["blob"].to_pylist()):
                text = _git(repository, "cat-file", "blob", blob).decode("utf-8", "replace")
                yield pa.RecordBatch.from_pydict({"path": [path], "revision": [revision], "text": [text]})

    schema = "path string, revision string, text string"
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(rows, "path string, blob string").repartition(min(parts, len(rows))).mapInArrow(read, schema)
