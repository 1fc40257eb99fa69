"""Mixing sources to target weights by balanced sampling with the cube method.

A source's share of the wanted total decides how often its documents are used on average: some whole number of times, and
once more for a sample of them. That sample is drawn by the cube method: all documents of the source start with the same
inclusion probability; in the flight phase probabilities are moved along vectors that change neither the
expected number of documents nor that of tokens, until each is 0 or 1, except for two documents that no such vector is
left for. Blocks of a source fly on their own and in parallel; what they leave over flies together in further passes, and
the last two documents of a source land one after the other, token balance given up first.
"""

from __future__ import annotations

import math
import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from ..session import materialize
from .tokens import VOCABULARY, count_tokens

#: Parameter: documents that fly together in one block.
BLOCK_ROWS = 8192
_NEAR = 1e-9


def source_name(source: Column) -> Column:
    """Folded, with "-" read as "_"."""
    return F.replace(fold(source), F.lit("-"), F.lit("_"))


def plan_uses(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: float) -> dict[str, float]:
    """How often a document of each source is used on average.

    tokens: of each source; targets: weight and most uses. Shares go by weight; a source that cannot fill its share is used
    as often as allowed, and the others share the rest by weight. Sources without tokens, with a weight that is
    null or not above 0 or without an allowed use get 0.
    """
    usable = {s: (w, m) for s, (w, m) in targets.items() if tokens.get(s, 0) > 0 and w and w > 0 and m and m > 0}
    uses: dict[str, float] = {s: 0.0 for s in targets}
    open_sources, rest = set(usable), float(total)
    while open_sources:
        weight = math.fsum(usable[s][0] for s in open_sources)
        full = {s for s in open_sources if rest * usable[s][0] / weight >= usable[s][1] * tokens[s]}
        for s in sorted(full or open_sources):
            uses[s] = float(usable[s][1]) if full else rest * usable[s][0] / weight / tokens[s]
        if not full:
            break
        rest = max(0.0, rest - sum(usable[s][1] * tokens[s] for s in full))
        open_sources -= full
    return uses


def fly(p: list[float], sizes: list[float], rng: random.Random) -> list[float]:
    """Flight phase with the constraints count and size: probabilities that are all 0 or 1 but for two at most."""
    p = list(p)
    loose: list[int] = []
    for new in range(len(p)):
        if not _NEAR < p[new] < 1 - _NEAR:
            p[new] = float(round(p[new]))
            continue
        loose.append(new)
        while len(loose) > 2:
            i, j, k = loose
            move = (sizes[k] - sizes[j], sizes[i] - sizes[k], sizes[j] - sizes[i])
            if not any(move):
                move = (1.0, -1.0, 0.0)
            up = min(((1 - p[u]) / v if v > 0 else -p[u] / v) for u, v in zip(loose, move) if v)
            down = min((p[u] / v if v > 0 else (p[u] - 1) / v) for u, v in zip(loose, move) if v)
            step = up if rng.random() * (up + down) < down else -down
            for u, v in zip(loose, move):
                p[u] += step * v
            loose = [u for u in loose if _NEAR < p[u] < 1 - _NEAR]
            for u in (i, j, k):
                if u not in loose:
                    p[u] = float(round(p[u]))
    return p


def land(p: list[float], rng: random.Random) -> list[float]:
    """The last probabilities: pairs keep their sum as long as possible, a single one is drawn."""
    p = list(p)
    loose = [i for i, x in enumerate(p) if _NEAR < x < 1 - _NEAR]
    while len(loose) > 1:
        i, j = loose[:2]
        up, down = min(1 - p[i], p[j]), min(p[i], 1 - p[j])
        step = up if rng.random() * (up + down) < down else -down
        p[i], p[j] = p[i] + step, p[j] - step
        for u in (i, j):
            if not _NEAR < p[u] < 1 - _NEAR:
                p[u] = float(round(p[u]))
        loose = [u for u in loose if _NEAR < p[u] < 1 - _NEAR]
    for i in loose:
        p[i] = float(rng.random() < p[i])
    return p


def _fly_block(last: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("tokens", "descending"), ("draw", "ascending")])  # what is left over at the end is small
        rng = random.Random("\0".join(str(k.as_py()) for k in key))
        p = fly(table["p"].to_pylist(), [float(x) for x in table["tokens"].to_pylist()], rng)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(land(p, rng) if last else p, pa.float64()))

    return run


def mix(
    documents: DataFrame, key: str, source: str, text: str, targets: DataFrame, path: str = VOCABULARY, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(chosen, report).

    chosen: key, source, tokens, repeats (1 or more) of the documents of the mix. report: for each target source target_weight,
    target_share, max_repeats, documents, tokens, planned_share, mixed_documents, mixed_tokens, reached_share.
    The mix has about as many tokens as ``documents``. Sources are compared folded with "-" read as "_"; targets of one name count
    once, with the greatest weight. Documents of other or null sources and those without tokens (null and
    empty texts) only count in the wanted total. Every row is a document of its own, repeated or not; extra columns are ignored.
    """
    counted = count_tokens(documents.select(F.col(key).alias("id"), source_name(F.col(source)).alias("source"), text), text, path)
    counted = materialize(counted)
    wanted = targets.select(source_name(F.col("source")).alias("source"), F.col("target_weight").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("m"))
    wanted = wanted.filter("source is not null").groupBy("source").agg(F.max(F.struct("w", "m")).alias("x")).select("source", "x.w", "x.m")
    per_source = wanted.join(counted.filter("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "source", "left")
    facts = per_source.collect()  # one row a target
    total = counted.agg(F.sum("tokens")).first()[0] or 0
    tokens = {r["source"]: r["tokens"] or 0 for r in facts}
    uses = plan_uses(tokens, {r["source"]: (r["w"], r["m"]) for r in facts}, total)

    spark = documents.sparkSession
    plan = spark.createDataFrame(
        [(s, math.floor(u + _NEAR), max(0.0, u - math.floor(u + _NEAR)), max(1, -(-(next(r["n"] or 0 for r in facts if r["source"] == s)) // block_rows))) for s, u in uses.items()],
        "source string, whole int, p double, blocks int",
    )
    draw = F.xxhash64("id", "source", "tokens")
    units = counted.filter("tokens > 0").join(F.broadcast(plan), "source").filter("whole > 0 or p > 0").withColumn("draw", draw)
    done = units.filter(F.col("p") <= _NEAR).select("id", "source", "tokens", F.lit(0.0).alias("p"), "whole")
    flying = units.filter(F.col("p") > _NEAR).withColumn("block", F.pmod(F.xxhash64("draw"), F.col("blocks")).cast("int"))
    schema = "id {0}, source string, tokens int, p double, whole int, draw bigint, block int".format(counted.schema["id"].dataType.simpleString())
    blocks = max((r[3] for r in plan.collect()), default=1)
    parts = [done]
    while True:
        last = blocks == 1
        flown = flying.select("id", "source", "tokens", "p", "whole", "draw", "block").groupBy("source", "block").applyInArrow(_fly_block(last), schema)
        if last:
            parts.append(flown.select("id", "source", "tokens", "p", "whole"))
            break
        flown = materialize(flown)
        loose = (F.col("p") > 0) & (F.col("p") < 1)
        parts.append(flown.filter(~loose).select("id", "source", "tokens", "p", "whole"))
        together = block_rows // 4  # blocks whose leftovers, two each, fly together next
        flying = flown.filter(loose).withColumn("block", F.floor(F.col("block") / together).cast("int"))
        blocks = -(-blocks // together)
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    repeats = (F.col("whole") + F.round("p")).cast("int")
    chosen = everything.select(F.col("id").alias(key), "source", "tokens", repeats.alias("repeats")).filter("repeats > 0")

    weight = math.fsum(r["w"] for r in facts if r["w"] and r["w"] > 0) or 1.0
    planned = {r["source"]: uses[r["source"]] * tokens[r["source"]] for r in facts}
    all_planned = math.fsum(planned.values()) or 1.0
    head = spark.createDataFrame(
        [(r["source"], r["w"], (r["w"] or 0.0) / weight, r["m"], r["n"] or 0, tokens[r["source"]], planned[r["source"]] / all_planned) for r in facts],
        "source string, target_weight double, target_share double, max_repeats int, documents bigint, tokens bigint, planned_share double",
    )
    reached = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("mixed_documents"), F.sum(F.col("tokens").cast("bigint") * F.col("repeats")).alias("mixed_tokens"))
    report = head.join(F.broadcast(reached), "source", "left").na.fill(0, ["mixed_documents", "mixed_tokens"])
    share = F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(_everything()), F.lit(0))
    return chosen, report.withColumn("reached_share", share)


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))
