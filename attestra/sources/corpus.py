"""Directories of UTF-8 texts as documents, and the check of source files against a manifest."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digest import digest
from ..functions.text import relative_path


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Unicode NFC."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def _below(root: str):
    prefix = root.rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*(?=/)", "")
    return F.when(path.startswith(prefix), path.substr(F.lit(len(prefix) + 1), F.length(path)))


def scan_directory(spark: SparkSession, root: str, namespace: str, glob: str = "*") -> DataFrame:
    """document_id, document_version_id, relative_path, text of every file below ``root``, hidden ones excepted.

    The document is named by namespace and normalised path, its version by the bytes as well. Files that are not UTF-8 decode with
    replacement characters. An empty directory gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    files = files.withColumn("relative_path", composed(relative_path(_below(root)))).filter("relative_path is not null")
    content = F.sha2("content", 256)
    document = digest(F.lit(namespace), F.col("relative_path"))
    return files.select(document.alias("document_id"), digest(document, content).alias("document_version_id"), "relative_path", F.decode("content", "UTF-8").alias("text"))


def verify_files(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """relative_path, state of every manifest row (relative_path, sha256): ok, unsafe_path, missing or changed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    found = files.select(_below(root).alias("relative_path"), F.sha2("content", 256).alias("found"))
    rows = manifest.select("relative_path", "sha256").withColumn("safe", relative_path(F.col("relative_path")))
    joined = rows.join(found, "relative_path", "left")
    state = (
        F.when(F.col("safe").isNull(), "unsafe_path").when(F.col("found").isNull(), "missing").when(F.col("found") != F.lower("sha256"), "changed").otherwise("ok")
    )
    return joined.select("relative_path", state.alias("state"))
