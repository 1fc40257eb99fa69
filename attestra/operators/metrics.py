"""Evaluation operators: classification, calibration, ranking and event metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import hash_draw
from .shape import numbered, side_by_side

#: The labels in their stored order and the floor of a probability in a logarithm.
LABELS, FLOOR = ("support", "refute", "neutral"), 1e-15


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(counts: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1, present of every label that is true or predicted somewhere; 0 where a denominator is 0."""
    sides = F.array(F.struct(F.col(truth).alias("label"), F.lit(True).alias("is_truth")), F.struct(F.col(predicted).alias("label"), F.lit(False).alias("is_truth")))
    rows = counts.select("n", (F.col(truth) == F.col(predicted)).alias("hit"), F.explode(sides).alias("x"))
    sums = rows.groupBy(F.col("x.label").alias("label")).agg(
        F.sum(F.when(F.col("x.is_truth") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("x.is_truth"), F.col("n")).otherwise(0)).alias("truths"),
        F.sum(F.when(~F.col("x.is_truth"), F.col("n")).otherwise(0)).alias("guesses"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return sums.select(
        "label",
        ratio(F.col("tp"), F.col("guesses")).alias("precision"),
        ratio(F.col("tp"), F.col("truths")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("truths") + F.col("guesses")).alias("f1"),
        (F.col("truths") > 0).alias("present"),
    )


def accuracy_and_macro_f1(counts: DataFrame, truth: str, predicted: str) -> DataFrame:
    """accuracy and macro_f1 over the labels that are true somewhere."""
    f1 = class_metrics(counts, truth, predicted).filter("present").agg(F.avg("f1").alias("macro_f1"))
    hits = counts.agg((F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return side_by_side(hits, f1)


def brier(truth: str, probabilities: dict[str, str]) -> Column:
    return sum((F.pow(F.col(p) - F.when(F.col(truth) == label, 1.0).otherwise(0.0), 2) for label, p in probabilities.items()), F.lit(0.0))


def log_loss(truth: str, probabilities: dict[str, str]) -> Column:
    p = F.coalesce(*[F.when(F.col(truth) == label, F.col(p)) for label, p in probabilities.items()])
    return -F.log(F.greatest(p, F.lit(FLOOR)))


def bin_of(confidence: Column, bins: int = 10) -> Column:
    """The equal bin [k/bins, (k+1)/bins) of a confidence, the last with its upper end; compared with the edges themselves."""
    return sum((F.when(confidence >= F.lit(k / bins), 1).otherwise(0) for k in range(1, bins)), F.lit(0))


def reliability(rows: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """bin, n, confidence, accuracy of the bins that hold rows."""
    out = rows.groupBy(bin_of(F.col(confidence), bins).alias("bin"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def micro_macro(rows: DataFrame, numerator: str, denominator: str, cluster: str) -> DataFrame:
    """micro (ratio of sums), macro (mean of the defined ratios), cluster_macro (mean of the defined ratios of clusters); 0/0 is null."""
    n, d = F.col(numerator), F.col(denominator)
    flat = rows.agg((F.sum(n) / F.nullif(F.sum(d), F.lit(0))).alias("micro"), F.avg(n / F.nullif(d, F.lit(0))).alias("macro"))
    by = rows.groupBy(cluster).agg((F.sum(n) / F.nullif(F.sum(d), F.lit(0))).alias("x")).agg(F.avg("x").alias("cluster_macro"))
    return side_by_side(flat, by)


def percentiles(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """n, median, p90 (interpolated), p95 and p99 (nearest rank) of each group, exact."""
    return rows.groupBy(*group).agg(
        F.count(value).alias("n"),
        F.median(value).alias("median"),
        F.percentile(value, F.lit(0.9)).alias("p90_linear"),
        F.expr(f"percentile_disc(0.95) within group (order by `{value}`)").alias("p95"),
        F.expr(f"percentile_disc(0.99) within group (order by `{value}`)").alias("p99"),
    )


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """query, recall, reciprocal_rank, ndcg at k of every query with relevant items.

    ranked: query, item, rank; relevant: query, item. The ideal gain uses as many items as are relevant, k at most.
    """
    wanted = relevant.select(query, item).distinct()
    hits = ranked.filter(F.col("rank") <= k).join(wanted, [query, item])
    gains = hits.groupBy(query).agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 1)).alias("dcg"))
    rows = wanted.groupBy(query).agg(F.count(F.lit(1)).alias("relevant")).join(gains, query, "left").na.fill(0, ["hits"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant").cast("int"), F.lit(k))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1))
    return rows.select(
        query,
        (F.col("hits") / F.col("relevant")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"),
    )


def cluster_bootstrap(clusters: DataFrame, cluster: str, numerator: str, denominator: str, replicates: int, seed: str) -> DataFrame:
    """replicate, value: the ratio of sums over as many clusters as there are, drawn with replacement by portable hash draws.

    clusters: one row a cluster with its sums. Draws are joined with the numbered clusters, so nothing is collected.
    """
    places = numbered(clusters, cluster, "i")
    n = places.count()
    draws = places.select(F.col("i").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    pick = hash_draw(F.lit(n), F.lit(seed), F.col("replicate").cast("string"), F.col("slot").cast("string"))
    drawn = draws.select("replicate", pick.alias("i")).groupBy("replicate", "i").agg(F.count(F.lit(1)).alias("times"))
    rows = drawn.join(places, "i").groupBy("replicate")
    sums = [F.sum(F.col("times") * F.col(c)) for c in (numerator, denominator)]
    return rows.agg((sums[0] / F.nullif(sums[1], F.lit(0))).alias("value"))


def group_balanced_loss(rows: DataFrame, domain: str, group: str, loss: str) -> DataFrame:
    """balanced_loss: the mean over domains of the mean over their groups of the mean loss."""
    by_group = rows.groupBy(domain, group).agg(F.avg(loss).alias("x"))
    return by_group.groupBy(domain).agg(F.avg("x").alias("x")).agg(F.avg("x").alias("balanced_loss"))


def fit_temperature(rows: DataFrame, truth: str, logits: dict[str, str], lower: float = 0.05, upper: float = 20.0, points: int = 33, stages: int = 4) -> tuple[float, float, float]:
    """(temperature, mean log loss at 1, mean log loss at the temperature): the least loss, which has one minimum in the temperature.

    Each stage is one aggregation over a grid of ``points`` on the logarithm, the next one lies between the neighbours of the best
    point; four stages find the temperature to about 0.005 %. A minimum at ``lower`` or ``upper`` is an error, as are no rows.
    """

    def losses(grid: list[float]) -> list[float]:
        top = F.greatest(*[F.col(c) for c in logits.values()])
        own = F.coalesce(*[F.when(F.col(truth) == label, F.col(c)) for label, c in logits.items()])
        at = [F.avg(F.log(sum((F.exp((F.col(c) - top) / t) for c in logits.values()), F.lit(0.0))) - (own - top) / t) for t in map(math.exp, grid)]
        return list(rows.agg(*[x.alias(f"l{i}") for i, x in enumerate(at)]).first())

    before, start, span, best = losses([0.0])[0], math.log(lower), math.log(upper) - math.log(lower), 0
    if before is None:
        raise ValueError("no rows to fit a temperature on")
    for stage in range(stages):
        grid = [start + i * span / (points - 1) for i in range(points)]
        found = losses(grid)
        best = min(range(points), key=found.__getitem__)
        if stage == 0 and best in (0, points - 1):
            raise ValueError("the loss has no minimum between the bounds")
        step = span / (points - 1)
        start, span = grid[best] - step, 2 * step
    return math.exp(grid[best]), before, found[best]


def false_invalidations(predicted: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """false_invalidations (predicted and unchanged) and stale_exposures (changed and not predicted)."""
    rows = predicted.select(key, F.lit(1).alias("p")).join(changed.select(key, F.lit(1).alias("c")), key, "full")
    return rows.agg(F.count_if(F.col("c").isNull()).alias("false_invalidations"), F.count_if(F.col("p").isNull()).alias("stale_exposures"))
