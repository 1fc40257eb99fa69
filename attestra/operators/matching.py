"""Evidence groups: bounded bipartite matching between requirements (at most 8) and distinct text hashes.

Counting works on masks: the set of requirements a hash supports is one integer, so a group is described by how many hashes have
each mask, and Hall's condition is checked for its at most 255 subsets inside the JVM. Certificates need an actual
matching and run per group in Python over at most 8 representatives for each mask.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digest import digest

#: Fixed value: the most requirements a group may have.
MOST_REQUIREMENTS = 8


def requirement_edges(edges: DataFrame) -> DataFrame:
    """group_id, ordinal, text_hash, observations, observation_ids (sorted, comma-joined), least_observation."""
    return edges.groupBy("group_id", "ordinal", "text_hash").agg(
        F.count(F.lit(1)).alias("observations"),
        F.array_join(F.sort_array(F.collect_list("observation_id")), ",").alias("observation_ids"),
        F.min("observation_id").alias("least_observation"),
    )


def requirement_states(requirements: DataFrame, edges: DataFrame) -> DataFrame:
    """group_id, ordinal, witness_hashes (sorted, comma-joined), witness_count, satisfied."""
    seen = edges.groupBy("group_id", "ordinal").agg(F.sort_array(F.collect_set("text_hash")).alias("h"))
    rows = requirements.select("group_id", "ordinal").join(seen, ["group_id", "ordinal"], "left")
    count = F.coalesce(F.size("h"), F.lit(0))
    return rows.select("group_id", "ordinal", F.coalesce(F.array_join("h", ","), F.lit("")).alias("witness_hashes"), count.alias("witness_count"), (count > 0).alias("satisfied"))


def hash_masks(edges: DataFrame) -> DataFrame:
    """group_id, text_hash, mask: the requirements each hash supports, bit i for ordinal i."""
    return edges.groupBy("group_id", "text_hash").agg(F.bit_or(F.expr("shiftleft(1, ordinal)")).alias("mask"))


def group_sizes(requirements: DataFrame) -> DataFrame:
    """group_id, r; groups of more than MOST_REQUIREMENTS are left out: their subsets are never made."""
    return requirements.groupBy("group_id").agg(F.count(F.lit(1)).cast("int").alias("r")).filter(F.col("r") <= MOST_REQUIREMENTS)


def hall_subsets(requirements: DataFrame, edges: DataFrame) -> DataFrame:
    """group_id, subset, neighbours, deficiency for every non-empty subset of the requirements of each group.

    One shuffle by group: the masks of a group are a small map (mask to number of hashes), which every subset sums up.
    """
    masks = hash_masks(edges).groupBy("group_id", "mask").agg(F.count(F.lit(1)).alias("n"))
    masks = masks.groupBy("group_id").agg(F.collect_list(F.struct("mask", "n")).alias("masks"))
    rows = group_sizes(requirements).join(masks, "group_id", "left")
    rows = rows.select("group_id", "masks", F.explode(F.expr("sequence(1, shiftleft(1, r) - 1)")).alias("subset"))
    met = F.aggregate(F.filter("masks", lambda x: x["mask"].bitwiseAND(F.col("subset")) != 0), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    neighbours = F.coalesce(met, F.lit(0).cast("bigint"))
    return rows.select("group_id", "subset", neighbours.alias("neighbours"), (F.bit_count("subset") - neighbours).alias("deficiency"))


def group_states(requirements: DataFrame, edges: DataFrame) -> DataFrame:
    """group_id, r, matching_size, complete by Hall's theorem: r less the greatest deficiency of a subset, if above 0.

    The greatest deficiency is found within the row of the group, over its masks with their numbers of hashes.
    """
    masks = hash_masks(edges).groupBy("group_id", "mask").agg(F.count(F.lit(1)).alias("n"))
    masks = masks.groupBy("group_id").agg(F.collect_list(F.struct("mask", "n")).alias("masks"))  # at most 255 masks
    rows = group_sizes(requirements).join(masks, "group_id", "left")
    worst = F.expr(
        "array_max(transform(sequence(1, shiftleft(1, r) - 1), s -> bit_count(s) - aggregate(filter(coalesce(masks, array()), x -> (x.mask & s) <> 0), 0L, (a, x) -> a + x.n)))"
    )
    rows = rows.withColumn("d", worst)
    return rows.select("group_id", "r", (F.col("r") - F.greatest(F.lit(0), F.col("d"))).alias("matching_size"), (F.col("d") <= 0).alias("complete"))


def assignment_sizes(requirements: DataFrame, edges: DataFrame) -> DataFrame:
    """group_id, matching_size by exhaustive search: at most 8 unrolled steps over distinct states (used requirements), one
    step for each mask class taken in turn, which stays within 256 states a group."""
    # of a mask with c ones at most c hashes can serve, so further ones never matter
    masks = hash_masks(edges).groupBy("group_id", "mask").agg(F.least(F.count(F.lit(1)), F.max(F.bit_count("mask")).cast("bigint")).alias("n"))
    takes = masks.select("group_id", "mask", F.explode(F.expr("sequence(1, n)")).alias("k"))
    items = takes.groupBy("group_id").agg(F.collect_list("mask").alias("items"))
    reach = F.aggregate(
        "items",
        F.expr("array(0)"),
        lambda states, mask: F.array_distinct(
            F.concat(
                states,
                F.flatten(
                    F.transform(
                        states,
                        lambda used: F.filter(
                            F.transform(F.sequence(F.lit(0), F.lit(MOST_REQUIREMENTS - 1)), lambda bit: _take(used, mask, bit)), lambda x: x.isNotNull()
                        ),
                    )
                ),
            )
        ),
    )
    best = items.select("group_id", F.array_max(F.transform(reach, lambda x: F.bit_count(x))).alias("matching_size"))
    return group_sizes(requirements).select("group_id").join(best, "group_id", "left").na.fill(0, ["matching_size"])


def _take(used: Column, mask: Column, bit: Column) -> Column:
    one = F.call_function("shiftleft", F.lit(1), bit)
    return F.when((mask.bitwiseAND(one) != 0) & (used.bitwiseAND(one) == 0), used.bitwiseOR(one))


def hash_ordinals(edges: DataFrame) -> DataFrame:
    """group_id, text_hash, hash_ordinal: hashes of each group densely numbered from 0 in byte order."""
    order = Window.partitionBy("group_id").orderBy("text_hash")
    return edges.select("group_id", "text_hash").distinct().withColumn("hash_ordinal", F.dense_rank().over(order) - 1)


def assignment_preflight(requirements: DataFrame, edges: DataFrame, hashes: int = 16, most_edges: int = 128, bound: int = 100_000) -> DataFrame:
    """group_id, r, hash_count, edge_count, state_bound, capped: whether an exhaustive audit is out of bounds.

    state_bound: the sum over k of C(hash_count, k) * (r - k + 1) for k up to min(r, hash_count).
    """
    counts = edges.select("group_id", "ordinal", "text_hash").distinct().groupBy("group_id")
    counts = counts.agg(F.count_distinct("text_hash").alias("hash_count"), F.count(F.lit(1)).alias("edge_count"))
    rows = group_sizes(requirements).join(counts, "group_id", "left").na.fill(0, ["hash_count", "edge_count"])
    ks = F.sequence(F.lit(0), F.least(F.col("r"), F.col("hash_count").cast("int")))
    state_bound = F.aggregate(ks, F.lit(0.0), lambda a, k: a + binomial(F.col("hash_count"), k) * (F.col("r") - k + 1))
    rows = rows.withColumn("state_bound", F.round(state_bound).cast("bigint"))
    return rows.withColumn("capped", (F.col("hash_count") > hashes) | (F.col("edge_count") > most_edges) | (F.col("state_bound") > bound))


def binomial(n: Column, k: Column) -> Column:
    """C(n, k) as a double, exact while it is below 2**53."""
    steps = F.filter(F.sequence(F.lit(0), k), lambda i: i < k)
    return F.aggregate(steps, F.lit(1.0), lambda a, i: a * (n - i) / (i + 1))


def representatives(requirements: DataFrame, edges: DataFrame) -> DataFrame:
    """group_id, mask, text_hash: of each mask the first r hashes, which suffice for any matching."""
    rows = hash_masks(edges).join(group_sizes(requirements), "group_id")
    place = F.row_number().over(Window.partitionBy("group_id", "mask").orderBy("text_hash"))
    return rows.withColumn("place", place).filter("place <= r").select("group_id", "mask", "text_hash")


def maximum_matching(r: int, hash_masks: Iterable[tuple[str, int]]) -> dict[int, str]:
    """ordinal to hash, by augmenting paths in the order of ordinals and hashes."""
    hashes = sorted(hash_masks)
    owner: dict[str, int] = {}

    def augment(ordinal: int, seen: set[str]) -> bool:
        for h, mask in hashes:
            if mask >> ordinal & 1 and h not in seen:
                seen.add(h)
                if h not in owner or augment(owner[h], seen):
                    owner[h] = ordinal
                    return True
        return False

    for ordinal in range(r):
        augment(ordinal, set())
    return {ordinal: h for h, ordinal in owner.items()}


def _certify(key: tuple, table: pa.Table) -> pa.Table:
    r = table["r"][0].as_py()
    match = maximum_matching(r, zip(table["text_hash"].to_pylist(), table["mask"].to_pylist()))
    rows = sorted(match.items())
    group = table["group_id"][0].as_py()
    return pa.table(
        {
            "group_id": pa.array([group] * len(rows), table.schema.field("group_id").type),
            "ordinal": pa.array([o for o, _ in rows], pa.int32()),
            "text_hash": pa.array([h for _, h in rows], pa.string()),
        }
    )


def group_certificates(requirements: DataFrame, edges: DataFrame) -> DataFrame:
    """group_id, ordinal, text_hash, observation_id: for every complete group a perfect matching with the least observation of each edge."""
    complete = group_states(requirements, edges).filter("complete").select("group_id", "r")
    inputs = representatives(requirements, edges).join(complete, "group_id")
    kind = requirements.schema["group_id"].dataType.simpleString()
    rows = inputs.groupBy("group_id").applyInArrow(_certify, f"group_id {kind}, ordinal int, text_hash string")
    least = edges.groupBy("group_id", "ordinal", "text_hash").agg(F.min("observation_id").alias("observation_id"))
    return rows.join(least, ["group_id", "ordinal", "text_hash"])


def certificate_digests(rows: DataFrame, policy_version: str) -> DataFrame:
    """group_id, requirement_count, digest: content address of each certificate over its framed rows in ordinal order."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text_hash", "observation_id"))), lambda x: F.concat_ws("|", x["ordinal"], x["text_hash"], x["observation_id"]))
    joined = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("requirement_count"), F.array_join(parts, "\n").alias("body"))
    fields = [F.lit(policy_version), F.col("group_id").cast("string"), F.col("requirement_count").cast("string"), F.col("body")]
    return joined.select("group_id", "requirement_count", digest(*fields).alias("digest"))


def invalid_certificates(rows: DataFrame, requirements: DataFrame, edges: DataFrame) -> DataFrame:
    """group_id, reason of certificates that don't hold: a row without a live witness, a hash used twice, or rows missing."""
    dead = rows.join(edges, ["group_id", "ordinal", "text_hash", "observation_id"], "left_anti").select("group_id", F.lit("dead_witness").alias("reason"))
    counts = rows.groupBy("group_id").agg(F.count_distinct("ordinal").alias("n"), F.count_distinct("text_hash").alias("h"))
    counts = counts.join(group_sizes(requirements), "group_id")
    repeated = counts.filter("h < n").select("group_id", F.lit("repeated_hash").alias("reason"))
    missing = counts.filter("n <> r").select("group_id", F.lit("incomplete").alias("reason"))
    return dead.unionByName(repeated).unionByName(missing).distinct()


def coalesce_edge_deltas(refcounts: DataFrame, deltas: DataFrame) -> DataFrame:
    """group_id, ordinal, text_hash, before, after of the edges whose reference count a set of signed deltas changes.

    A count below 0 marks an underflow and is kept to be seen.
    """
    key = ["group_id", "ordinal", "text_hash"]
    moved = deltas.groupBy(*key).agg(F.sum("delta").alias("delta")).filter("delta <> 0")
    rows = moved.join(refcounts.select(*key, F.col("n").alias("before")), key, "left").na.fill(0, ["before"])
    return rows.select(*key, "before", (F.col("before") + F.col("delta")).alias("after"))


def mask_transitions(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """group_id, text_hash, old_mask, new_mask of the hashes whose set of requirements changes with ``changes`` of
    coalesce_edge_deltas; ``edges``: the edges before."""
    bit = F.expr("shiftleft(1, ordinal)")
    gone = F.bit_or(F.when((F.col("before") > 0) & (F.col("after") <= 0), bit).otherwise(0)).alias("gone")
    come = F.bit_or(F.when((F.col("before") <= 0) & (F.col("after") > 0), bit).otherwise(0)).alias("come")
    moved = changes.groupBy("group_id", "text_hash").agg(gone, come).filter("gone <> 0 or come <> 0")
    rows = moved.join(hash_masks(edges), ["group_id", "text_hash"], "left").na.fill(0, ["mask"])
    new = F.col("mask").bitwiseAND(F.bitwise_not(F.col("gone"))).bitwiseOR(F.col("come"))
    return rows.select("group_id", "text_hash", F.col("mask").alias("old_mask"), new.alias("new_mask"))


def combined_claims(direct: DataFrame, complete_groups: DataFrame) -> DataFrame:
    """Claim states in which a complete group supports a claim as a direct witness does; refutation stays direct.

    complete_groups: claim_id, group_id. Adds complete_groups (number) and group_ids; status is the combined one.
    """
    from ..functions.policy import claim_status

    groups = complete_groups.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("complete_groups"), F.array_join(F.sort_array(F.collect_list(F.col("group_id").cast("string"))), ",").alias("group_ids")
    )
    rows = direct.join(groups, "claim_id", "left").na.fill(0, ["complete_groups"]).na.fill("", ["group_ids"])
    return rows.withColumn("status", claim_status(F.col("support_count") + F.col("complete_groups"), F.col("refute_count")))


def combined_certificates(claims: DataFrame, least: DataFrame, certificates: DataFrame) -> DataFrame:
    """claim_id, support_kind (direct, group, none), support_ref, refute_id: the least direct support first, else the least complete group."""
    groups = certificates.groupBy("claim_id").agg(F.min("group_id").alias("g"))
    rows = claims.select("claim_id").join(least, "claim_id", "left").join(groups, "claim_id", "left")
    kind = F.when(F.col("support_id").isNotNull(), "direct").when(F.col("g").isNotNull(), "group").otherwise("none")
    return rows.select("claim_id", kind.alias("support_kind"), F.coalesce("support_id", F.col("g").cast("string")).alias("support_ref"), "refute_id")
