"""JSON lines: strict reading, reading with typed rejects, writing."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, any other line that is no object of the schema fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _line_faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    class Repeated(ValueError):
        pass

    def unique(pairs: list) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise Repeated
        return dict(pairs)

    for batch in batches:
        faults = []
        for line in batch["line"].to_pylist():
            try:
                faults.append(None if isinstance(json.loads(line, object_pairs_hook=unique), dict) else "not_an_object")
            except Repeated:
                faults.append("repeated_key")
            except ValueError:
                faults.append("not_json")
        yield pa.RecordBatch.from_arrays([batch["file"], batch["line"], pa.array(faults, pa.string())], ["file", "line", "fault"])


def read_with_rejects(spark: SparkSession, path: str, schema: T.StructType, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON-lines files.

    rejects: file, line, reason: not_json, not_an_object, repeated_key (Spark alone would keep one of the values), or the first of
    ``checks`` (reason to a condition on the parsed columns that good rows meet; a null counts as not met). Blank lines are skipped.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).filter(F.trim("line") != "")
    parsed = lines.mapInArrow(_line_faults, "file string, line string, fault string").withColumn("row", F.from_json("line", schema))
    fields = parsed.select("file", "line", "fault", "row.*")
    reason = F.col("fault")
    for name, condition in checks.items():
        reason = F.coalesce(reason, F.when(~F.coalesce(condition, F.lit(False)), name))
    marked = fields.withColumn("__reason", reason)
    rows = marked.filter("__reason is null").select(*schema.fieldNames())
    return rows, marked.filter("__reason is not null").select("file", "line", F.col("__reason").alias("reason"))


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines with keys in alphabetical order, for reports and examples."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
