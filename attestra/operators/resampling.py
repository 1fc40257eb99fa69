"""Bootstraps with intervals, drawn by portable hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import hash_draw
from .metrics import cluster_bootstrap
from .shape import side_by_side

#: Range of a draw, and the shares of it below which a row is drawn at most 0, 1, ... times (Poisson of mean 1).
RANGE = 1 << 32
POISSON = [int(RANGE * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(9)]


def interval(replicates: DataFrame, confidence: float) -> DataFrame:
    """lower, upper: the linear percentiles of the replicate values; null without any."""
    tail = (1.0 - confidence) / 2.0
    return replicates.agg(F.percentile("value", F.lit(tail)).alias("lower"), F.percentile("value", F.lit(1.0 - tail)).alias("upper"))


def times_drawn(seed: str, replicate: Column, key: Column) -> Column:
    """How often a row is drawn in a replicate: independent of all other rows, so no row has to be numbered or looked up."""
    draw = hash_draw(F.lit(RANGE), F.lit(seed), replicate.cast("string"), key)
    return sum(((draw >= F.lit(bound)).cast("int") for bound in POISSON), F.lit(0))


def iid_interval(rows: DataFrame, key: Column, value: Column, replicates: int, seed: str, confidence: float = 0.95) -> DataFrame:
    """observed, lower, upper of the mean of ``value``. One pass: each row gives its weighted sums to every replicate (Poisson bootstrap), and
    the replicates are summed up before the shuffle."""
    draws = rows.select(key.alias("k"), value.cast("double").alias("v")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    times = times_drawn(seed, F.col("replicate"), F.col("k"))
    sums = draws.select("replicate", "v", times.alias("w")).filter("w > 0").groupBy("replicate").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("value"))
    return side_by_side(rows.agg(F.avg(value.cast("double")).alias("observed")), interval(sums, confidence))


def cluster_interval(clusters: DataFrame, cluster: str, numerator: str, denominator: str, replicates: int, seed: str, confidence: float = 0.95) -> DataFrame:
    """observed, lower, upper of the ratio of sums, resampled by whole clusters. clusters: one row a cluster with its sums."""
    observed = clusters.agg((F.sum(numerator) / F.nullif(F.sum(denominator), F.lit(0))).alias("observed"))
    return side_by_side(observed, interval(cluster_bootstrap(clusters, cluster, numerator, denominator, replicates, seed), confidence))


def paired_interval(clusters: DataFrame, cluster: str, first: str, second: str, denominator: str, replicates: int, seed: str, confidence: float = 0.95, least: int = 2) -> DataFrame:
    """clusters, observed, lower, upper of the mean over clusters of the difference of two ratios with one denominator, both arms on the
    same draws. Clusters with a denominator of 0 take no part; with fewer than ``least`` clusters there is no interval."""
    rows = clusters.filter(F.col(denominator) > 0).select(cluster, ((F.col(first) - F.col(second)) / F.col(denominator)).alias("d"), F.lit(1).alias("one"))
    observed = rows.agg(F.count(F.lit(1)).alias("clusters"), F.avg("d").alias("observed"))
    bounds = interval(cluster_bootstrap(rows, cluster, "d", "one", replicates, seed), confidence)
    out = side_by_side(observed, bounds)
    enough = F.col("clusters") >= least
    return out.select("clusters", "observed", F.when(enough, F.col("lower")).alias("lower"), F.when(enough, F.col("upper")).alias("upper"))


#: The clauses of the verdict, over the primary seed's row; ``passing`` is the number of seeds that reach all three floors.
FLOORS = "joint >= 0.30 and flip >= 0.50 and margin >= 0.75"
CLAUSES = {
    "G1": "joint >= 0.30 and passing >= 2",
    "G2": "flip >= 0.50 and passing >= 2",
    "G3": "margin >= 0.75 and passing >= 2",
    "G4": "joint_lower > 0 and joint_delta >= 0.10",
    "G5": "flip_lower > 0",
    "G6": "margin_lower >= -0.03",
    "G7": "macro_f1 >= 0.4998 and accuracy >= 0.5873",
    "G8": "macro_f1_lower >= -0.05 and accuracy_lower >= -0.05",
    "G9": "calibrated",
    "G10": "provenance and complete_seeds = seeds",
}


def verdict(by_seed: DataFrame, primary: int, provenance: bool) -> DataFrame:
    """passing, failed (clauses, comma-joined), verdict of an experiment: GO if no clause fails; INCONCLUSIVE if only the statistical
    clauses (G4, G5) do while the difference is large enough and an interval holds 0 and none lies below it; else NO_GO. No row for the
    primary seed gives NO_GO with all clauses failed.

    by_seed: seed, joint, flip, margin, joint_delta, joint_lower, joint_upper, flip_lower, flip_upper, margin_lower, macro_f1,
    accuracy, macro_f1_lower, accuracy_lower (doubles), calibrated, complete (booleans).
    """
    values = [c for c in by_seed.columns if c not in ("seed", "complete")]
    rows = by_seed.agg(
        F.count_if(F.expr(FLOORS)).alias("passing"), F.count_if("complete").alias("complete_seeds"), F.count(F.lit(1)).alias("seeds"),
        *[F.max(F.when(F.col("seed") == primary, F.col(c))).alias(c) for c in values],
    ).withColumn("provenance", F.lit(provenance))
    ok = {name: F.coalesce(F.expr(rule), F.lit(False)) for name, rule in CLAUSES.items()}
    failed = F.array_join(F.array_compact(F.array(*[F.when(~passed, F.lit(name)) for name, passed in ok.items()])), ",")
    safe = [ok[name] for name in ("G1", "G2", "G3", "G6", "G7", "G8", "G9", "G10")]
    open_ = F.expr("(joint_lower <= 0 and joint_upper >= 0 or flip_lower <= 0 and flip_upper >= 0) and not (joint_upper < 0 or flip_upper < 0) and joint_delta >= 0.10")
    inconclusive = ~(ok["G4"] & ok["G5"]) & F.coalesce(open_, F.lit(False))
    for passed in safe:
        inconclusive = inconclusive & passed
    return rows.select("passing", failed.alias("failed"), F.when(failed == "", "GO").when(inconclusive, "INCONCLUSIVE").otherwise("NO_GO").alias("verdict"))


def extraction_metrics(gold: DataFrame, predicted: DataFrame, compound: DataFrame, citations: DataFrame, resolvable: DataFrame) -> DataFrame:
    """One row of counts and rates of extracted texts against the wanted ones.

    gold, predicted, compound: case, text (normalised; compound texts are those known to hold several statements); predicted may repeat
    texts, the others may too but count once. citations: case, cited, one row a citation; resolvable: case, cited. Rates are 0 for no rows.
    """
    wanted = gold.select("case", "text").distinct()
    said = predicted.groupBy("case", "text").agg(F.count(F.lit(1)).alias("n"))
    both = wanted.withColumn("g", F.lit(True)).join(said, ["case", "text"], "full").join(compound.select("case", "text").distinct().withColumn("c", F.lit(True)), ["case", "text"], "left")
    counts = both.agg(
        F.count_if("g").alias("gold"), F.count_if(F.col("g") & F.col("n").isNotNull()).alias("covered"), F.coalesce(F.sum("n"), F.lit(0)).alias("predicted"),
        F.coalesce(F.sum(F.when(F.col("c"), F.col("n"))), F.lit(0)).alias("compound"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum(F.when(F.col("g").isNull(), F.col("n"))), F.lit(0)).alias("unsupported"),
    )
    cited = citations.join(resolvable.select("case", "cited").distinct().withColumn("ok", F.lit(True)), ["case", "cited"], "left").agg(F.count(F.lit(1)).alias("citations"), F.count_if("ok").alias("resolved"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return side_by_side(counts, cited).select("*", rate("covered", "gold").alias("coverage"), rate("resolved", "citations").alias("resolution_rate"))


def contrastive_ranking(pairs: DataFrame, group: str) -> DataFrame:
    """group, queries, recall_at_1, mrr of queries with one right and one wrong candidate. pairs: group, right, wrong (scores); a tie counts as
    found, a null score as below all others."""
    rank = F.when(F.coalesce(F.col("right"), F.lit(float("-inf"))) >= F.coalesce(F.col("wrong"), F.lit(float("-inf"))), 1.0).otherwise(2.0)
    return pairs.groupBy(group).agg(F.count(F.lit(1)).alias("queries"), F.avg((rank == 1.0).cast("double")).alias("recall_at_1"), F.avg(1.0 / rank).alias("mrr"))


def effect_recall(family: str, expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """family, numerator, denominator: how many of the different expected keys were found."""
    rows = expected.select(*key).distinct().join(found.select(*key).distinct().withColumn("f", F.lit(True)), key, "left")
    return rows.agg(F.count_if("f").alias("numerator"), F.count(F.lit(1)).alias("denominator")).select(F.lit(family).alias("family"), "numerator", "denominator")
