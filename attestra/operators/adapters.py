"""Parent and subclaim records as evidence groups, with typed rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adapt_subclaims(parents: DataFrame, subclaims: DataFrame, most_characters: int = 1200) -> tuple[DataFrame, DataFrame]:
    """(units, rejects).

    parents: split, parent_id, sentences (array of strings). subclaims: split, subclaim_id, parent_id, label, evidence_sets (array of arrays
    of sentence numbers from 0). units: split, subclaim_id, label, set_ordinal, sentence_numbers (sorted, different), text; equal sets of a
    subclaim count once, at their first place. rejects: split, subclaim_id, set_ordinal (null for the whole record), reason: repeated_parent,
    no_parent, no_evidence, empty_set, unknown_sentence, blank_sentence, too_long.
    """
    counts = parents.groupBy("split", "parent_id").agg(F.count(F.lit(1)).alias("copies"), F.any_value("sentences").alias("sentences"))
    rows = subclaims.select("split", "subclaim_id", "parent_id", "label", "evidence_sets").join(counts, ["split", "parent_id"], "left")
    whole = (
        F.when(F.col("copies").isNull(), "no_parent")
        .when(F.col("copies") > 1, "repeated_parent")
        .when(F.coalesce(F.size("evidence_sets"), F.lit(0)) <= 0, "no_evidence")
    )
    rows = rows.withColumn("reason", whole)
    broken = rows.filter("reason is not null").select("split", "subclaim_id", F.lit(None).cast("int").alias("set_ordinal"), "reason")

    sets = rows.filter("reason is null").select("split", "subclaim_id", "label", "sentences", F.posexplode("evidence_sets").alias("set_ordinal", "s"))
    sets = sets.withColumn("sentence_numbers", F.array_sort(F.array_distinct("s")))
    first = F.struct("set_ordinal", "label", "sentences")
    sets = sets.groupBy("split", "subclaim_id", "sentence_numbers").agg(F.min_by(first, "set_ordinal").alias("x"))
    sets = sets.select("split", "subclaim_id", "sentence_numbers", "x.*")
    outside = F.exists("sentence_numbers", lambda i: i.isNull() | (i < 0) | (i >= F.size("sentences")))
    lines = F.transform("sentence_numbers", lambda i: F.get("sentences", i))
    blank = F.exists(lines, lambda t: t.isNull() | (F.trim(t) == ""))
    text = F.array_join(lines, " ")
    reason = (
        F.when(F.coalesce(F.size("sentence_numbers"), F.lit(0)) <= 0, "empty_set")
        .when(outside, "unknown_sentence")
        .when(blank, "blank_sentence")
        .when(F.char_length(text) > most_characters, "too_long")
    )
    judged = sets.withColumn("text", text).withColumn("reason", reason)
    units = judged.filter("reason is null").select("split", "subclaim_id", "label", "set_ordinal", "sentence_numbers", "text")
    return units, broken.unionByName(judged.filter("reason is not null").select("split", "subclaim_id", "set_ordinal", "reason"))
