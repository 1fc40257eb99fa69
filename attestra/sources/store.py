"""Published snapshots on plain parquet: versions are written beside each other and a head names the one that counts."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.temporal import latest, overlay


#: Parameter: changes of a table that are kept beside it before it is written anew.
MOST_CHANGES = 16


class Store:
    """Tables below ``root`` in numbered versions.

    ``publish`` writes all that is new in a version first and moves the head last, so readers see the old or the new version and a job
    that died in between leaves no trace. Publishing a version at or below the head is a replay and does nothing. A table can be
    published whole or by its changed rows; those are kept as files of their own, which readers lay over the last whole table, and
    after MOST_CHANGES of them the table is written whole again. Tables that a version doesn't mention stay as they are.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def head(self) -> int | None:
        """The published version, None before the first."""
        path = self._path(f"{self.root}/_heads")
        if not self._fs.exists(path):
            return None
        versions = [int(s.getPath().getName()) for s in self._fs.listStatus(path)]
        return max(versions, default=None)

    def _manifest(self, version: int | None) -> dict:
        if version is None:
            return {"chains": {}}
        stream = self._fs.open(self._path(f"{self.root}/v={version}/manifest.json"))
        body = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(body)

    def publish(self, version: int, tables: dict[str, DataFrame], manifest: dict | None = None, changes: dict[str, tuple[DataFrame, list[str]]] | None = None) -> bool:
        """Whether the version is new; its tables are then what readers see. changes: table to (rows that are new or replace those of their
        key, key columns)."""
        head = self.head()
        if head is not None and version <= head:
            return False
        chains = self._manifest(head)["chains"]
        for name, (rows, key) in (changes or {}).items():
            chain = chains[name]
            if len(chain["changes"]) >= MOST_CHANGES:
                tables = tables | {name: overlay(self.read(name), rows, key, F.lit(False))}
            else:
                rows.write.mode("overwrite").parquet(f"{self.root}/v={version}/{name}")
                chains[name] = {"base": chain["base"], "changes": [*chain["changes"], version], "key": key}
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v={version}/{name}")
            chains[name] = {"base": version, "changes": [], "key": []}
        body = json.dumps({"version": version, "tables": sorted(tables), "chains": chains} | (manifest or {}), sort_keys=True, separators=(",", ":"))
        out = self._fs.create(self._path(f"{self.root}/v={version}/manifest.json"), True)
        out.write(bytearray(body.encode()))
        out.close()
        self._fs.mkdirs(self._path(f"{self.root}/_heads"))
        self._fs.create(self._path(f"{self.root}/_heads/{version}"), True).close()
        return True

    def read(self, name: str, version: int | None = None) -> DataFrame:
        chain = self._manifest(self.head() if version is None else version)["chains"][name]
        base = self.spark.read.parquet(f"{self.root}/v={chain['base']}/{name}")
        if not chain["changes"]:
            return base
        parts = [self.spark.read.parquet(f"{self.root}/v={v}/{name}").withColumn("__version", F.lit(v)) for v in chain["changes"]]
        changed = reduce(DataFrame.unionByName, parts)
        return overlay(base, latest(changed, chain["key"], ["__version"]).drop("__version"), chain["key"], F.lit(False))


def append_new(events: DataFrame, log: DataFrame, key: str, digest: str) -> DataFrame:
    """The events to append to the log; a known key with another digest fails the job when it is run."""
    seen = events.groupBy(key).agg(F.count_distinct(digest).alias("n"))
    joined = events.dropDuplicates([key, digest]).join(seen, key).join(log.select(key, F.col(digest).alias("__known")), key, "left")
    clash = (F.col("n") > 1) | (F.col("__known").isNotNull() & (F.col("__known") != F.col(digest)))
    message = F.concat(F.lit("conflicting payload of event "), F.col(key).cast("string"))
    new = F.when(clash, F.raise_error(message).cast("boolean")).otherwise(F.col("__known").isNull())
    return joined.filter(new).select(*events.columns)


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """CSV files with header, one folder a table; the files of a table, in the order of their names, hold its rows in the order of all
    columns. Small tables make one file, large ones are written by many tasks."""
    for name, df in tables.items():
        df.orderBy(*df.columns).write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}")


def bundle_manifest(tables: dict[str, DataFrame]) -> dict[str, dict[str, str | int]]:
    """table to number of rows, columns and an order-free digest of its rows, to be kept beside a report: equal tables have equal digests
    whatever their files and partitions are. The digest adds up row digests, so no rows are sorted or collected."""
    out: dict[str, dict[str, str | int]] = {}
    for name, df in sorted(tables.items()):
        row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        parts = [F.sum(F.conv(F.substring(row, 1 + 13 * i, 13), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(4)]
        got = df.agg(F.count(F.lit(1)).alias("n"), *parts).first()
        body = "|".join([name, str(got["n"]), *sorted(df.columns), *[got[f"s{i}"] or "0" for i in range(4)]])
        out[name] = {"rows": got["n"], "columns": ",".join(sorted(df.columns)), "sha256": hashlib.sha256(body.encode()).hexdigest()}
    return out


def bar_chart(rows: list[tuple[str, float]], title: str, width: int = 640) -> str:
    """An SVG bar chart of a short summary: one bar for each (name, value), values at least 0."""
    top = max((v for _, v in rows), default=0.0) or 1.0
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    bars = []
    for i, (name, value) in enumerate(rows):
        y, length = 40 + 26 * i, max(0.0, value) / top * (width - 260)
        bars.append(f'<text x="8" y="{y + 14}">{escape(name)}</text><rect x="180" y="{y}" width="{length:.1f}" height="18" fill="#4477aa"/><text x="{188 + length:.1f}" y="{y + 14}">{value:g}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{50 + 26 * len(rows)}" font-family="sans-serif" font-size="12"><text x="8" y="22" font-size="15">{escape(title)}</text>{"".join(bars)}</svg>'
