"""Group certificates over time: what a change of evidence or of policy does to selected witnesses and to their bindings.

A certificate is one row (group_id, ordinal, text_hash, observation_id) for each requirement of a complete group. Everything here is
decided for all groups at once by joins on the certificate rows, so a change costs the touched groups and not the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import temporal as T

_EDGE = ["group_id", "ordinal", "text_hash"]


def row_states(rows: DataFrame, live: DataFrame) -> DataFrame:
    """The certificate rows with alive (the selected observation is among the ``live`` ones: group_id, ordinal, text_hash,
    observation_id) and least (the least live observation of the edge, null if the edge has vanished)."""
    edges = live.groupBy(*_EDGE).agg(F.min("observation_id").alias("least"))
    alive = live.select(*_EDGE, "observation_id").distinct().withColumn("alive", F.lit(True))
    return rows.join(edges, _EDGE, "left").join(alive, [*_EDGE, "observation_id"], "left").na.fill(False, ["alive"])


def transitions(rows: DataFrame, live: DataFrame, complete: DataFrame, rebind: bool = False) -> DataFrame:
    """group_id, action, repairs, lost of every certified group.

    retain: all selected observations live; repair: all edges live, vanished observations are replaced; rebuild: an edge has vanished
    and the group is still complete (group_id in ``complete``); close: it is not. With ``rebind`` the decision policy has changed as
    well: retain and repair become rebind and rebind_repair, for each binding has to name the new policy.
    """
    states = row_states(rows, live).groupBy("group_id")
    counts = states.agg(F.count_if(~F.col("alive") & F.col("least").isNotNull()).alias("repairs"), F.count_if(F.col("least").isNull()).alias("lost"))
    counts = counts.join(complete.select("group_id").distinct().withColumn("still", F.lit(True)), "group_id", "left")
    kept = F.when(F.col("repairs") > 0, "rebind_repair" if rebind else "repair").otherwise("rebind" if rebind else "retain")
    action = F.when(F.col("lost") == 0, kept).when(F.col("still"), "rebuild").otherwise("close")
    return counts.select("group_id", action.alias("action"), "repairs", "lost")


def repaired(rows: DataFrame, live: DataFrame) -> DataFrame:
    """The rows of certificates that keep all their edges: selected observations that live stay, vanished ones become the least
    live one of their edge; replaced tells which."""
    states = row_states(rows, live)
    broken = states.filter("least is null").select("group_id").distinct()
    kept = states.join(broken, "group_id", "left_anti")
    new = F.when(F.col("alive"), F.col("observation_id")).otherwise(F.col("least"))
    return kept.select(*_EDGE, new.alias("observation_id"), (~F.col("alive")).alias("replaced"))


def bindings(actions: DataFrame, revision: int) -> DataFrame:
    """group_id, artifact (1 before, 2 after), from_revision, to_revision: the binding of each certificate, opened at revision 0, and what
    its action at ``revision`` makes of it. A retained binding stays open; all others are closed, and a new one is opened unless the action is close."""
    span = lambda artifact, start, end: F.struct(F.lit(artifact).alias("artifact"), F.lit(start).cast("bigint").alias("from_revision"), F.lit(end).cast("bigint").alias("to_revision"))
    spans = F.when(F.col("action") == "retain", F.array(span(1, 0, None))).when(F.col("action") == "close", F.array(span(1, 0, revision))).otherwise(F.array(span(1, 0, revision), span(2, revision, None)))
    return actions.select("group_id", F.explode(spans).alias("x")).select("group_id", "x.*")


def effective_bindings(history: DataFrame, key: str, epoch: int, revision: int) -> DataFrame:
    """The binding of each key at (epoch, revision): the one of that epoch that covers the revision, else the final open one of the latest
    epoch before. history: key, epoch, from_revision, to_revision and what is bound. A closed epoch before the point gives none."""
    now = history.filter((F.col("epoch") == epoch) & T.contains(revision, "from_revision", "to_revision"))
    before = history.filter(F.col("epoch") < epoch)
    final = T.latest(before, [key], ["epoch", "from_revision"]).filter("to_revision is null")
    return now.unionByName(final.join(now.select(key), key, "left_anti"))


def claim_transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """claim_id, action, old_ref, new_ref between two sets of claim certificates (claim_id, support_kind, support_ref): open, close, replace
    or retain; claims without a certificate on both sides drop out."""
    name = lambda df, ref: df.filter("support_kind <> 'none'").select("claim_id", F.concat_ws(":", "support_kind", "support_ref").alias(ref))
    rows = name(before, "old_ref").join(name(after, "new_ref"), "claim_id", "full")
    old, new = F.col("old_ref"), F.col("new_ref")
    action = F.when(old.isNull(), "open").when(new.isNull(), "close").when(old == new, "retain").otherwise("replace")
    return rows.select("claim_id", action.alias("action"), "old_ref", "new_ref")


# Hall counts


def subset_deltas(moved: DataFrame, sizes: DataFrame) -> DataFrame:
    """group_id, subset, delta: what mask transitions (group_id, text_hash, old_mask, new_mask) add to the neighbours of each subset of
    the requirements; zero deltas drop out. Transitions of equal masks are summed up before subsets are made of them."""
    sides = F.array(F.struct(F.col("old_mask").alias("mask"), F.lit(-1).alias("d")), F.struct(F.col("new_mask").alias("mask"), F.lit(1).alias("d")))
    by_mask = moved.select("group_id", F.explode(sides).alias("x")).groupBy("group_id", F.col("x.mask").alias("mask")).agg(F.sum("x.d").alias("d")).filter("d <> 0 and mask <> 0")
    lists = by_mask.groupBy("group_id").agg(F.collect_list(F.struct("mask", "d")).alias("masks"))  # at most 255 masks
    rows = lists.join(sizes, "group_id").select("group_id", "masks", F.explode(F.expr("sequence(1, shiftleft(1, r) - 1)")).alias("subset"))
    delta = F.aggregate(F.filter("masks", lambda x: x["mask"].bitwiseAND(F.col("subset")) != 0), F.lit(0).cast("bigint"), lambda a, x: a + x["d"])
    return rows.select("group_id", "subset", delta.alias("delta")).filter("delta <> 0")


def moved_subsets(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """group_id, subset, before, after of the subset counts (group_id, subset, neighbours) that deltas change."""
    rows = deltas.join(counts, ["group_id", "subset"])
    return rows.select("group_id", "subset", F.col("neighbours").alias("before"), (F.col("neighbours") + F.col("delta")).alias("after"))


def hall_arrays(counts: DataFrame) -> DataFrame:
    """group_id, neighbours: the counts of all subsets in the order of their number behind a 0 for the empty one, comma-joined."""
    pairs = F.sort_array(F.collect_list(F.struct("subset", "neighbours")))
    values = F.transform(pairs, lambda x: x["neighbours"].cast("string"))
    return counts.groupBy("group_id").agg(F.concat(F.lit("0,"), F.array_join(values, ",")).alias("neighbours"))


def invalid_arrays(arrays: DataFrame, sizes: DataFrame) -> DataFrame:
    """group_id, reason of stored arrays that no counts can have: wrong_length, bad_start, negative or shrinking (a subset with fewer
    neighbours than one inside it that lacks one requirement)."""
    rows = arrays.join(sizes, "group_id").withColumn("a", F.transform(F.split("neighbours", ","), lambda x: x.cast("bigint")))
    inside = F.expr("exists(sequence(1, size(a) - 1), s -> exists(sequence(0, 7), b -> (s & shiftleft(1, b)) <> 0 and a[s & ~shiftleft(1, b)] > a[s]))")
    reason = F.when(F.size("a") != F.expr("shiftleft(1, r)"), "wrong_length").when(F.col("a")[0] != 0, "bad_start").when(F.exists("a", lambda x: x < 0), "negative").when(inside, "shrinking")
    return rows.select("group_id", reason.alias("reason")).filter("reason is not null")


def perfect_matchings(requirements: DataFrame, masks: DataFrame) -> DataFrame:
    """group_id, perfect: how many ways there are to give every requirement a hash of its own.

    One pass over the hashes of a group, with the number of ways for each set of served requirements (at most 256) as its state; a
    group's hashes are one array, so groups are meant to be small, as evaluation groups are.
    """
    from .matching import group_sizes

    sets = masks.groupBy("group_id").agg(F.collect_list("mask").alias("masks"))
    rows = group_sizes(requirements).join(sets, "group_id", "left")
    step = """aggregate(coalesce(masks, array()), transform(sequence(0, shiftleft(1, r) - 1), m -> if(m = 0, 1L, 0L)), (ways, mask) -> transform(sequence(0, shiftleft(1, r) - 1), m ->
        ways[m] + aggregate(filter(sequence(0, r - 1), b -> (m & mask & shiftleft(1, b)) <> 0), 0L, (n, b) -> n + ways[m & ~shiftleft(1, b)])), ways -> ways[shiftleft(1, r) - 1])"""
    return rows.select("group_id", F.expr(step).alias("perfect"))


# the persisted image


def observation_index_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """group_id, ordinal, text_hash, added, removed, least_before, least_after of the edges whose set of observations changes."""
    side = lambda df, name: df.select(*_EDGE, "observation_id").distinct().withColumn(name, F.lit(True))
    rows = side(before, "b").join(side(after, "a"), [*_EDGE, "observation_id"], "full")
    counts = rows.groupBy(*_EDGE).agg(
        F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("removed"),
        F.min(F.when(F.col("b"), F.col("observation_id"))).alias("least_before"), F.min(F.when(F.col("a"), F.col("observation_id"))).alias("least_after"),
    )
    return counts.filter("added > 0 or removed > 0")


def image_mismatches(persisted: DataFrame, replayed: DataFrame, key: list[str], family: str) -> DataFrame:
    """family, persisted, replayed, mismatches: rows of an image table, of its replay, and of those that differ or are on one side only."""
    columns = [c for c in persisted.columns if c not in key]
    a = persisted.select(*key, F.struct(F.lit(1).alias("one"), *columns).alias("p"))
    b = replayed.select(*key, F.struct(F.lit(1).alias("one"), *columns).alias("q"))
    rows = a.join(b, key, "full").agg(F.count("p").alias("persisted"), F.count("q").alias("replayed"), F.count_if(~F.col("p").eqNullSafe(F.col("q"))).alias("mismatches"))
    return rows.select(F.lit(family).alias("family"), "persisted", "replayed", "mismatches")


# group families


def group_events(events: DataFrame) -> DataFrame:
    """The events with reason: null for an accepted one.

    events: epoch, family, kind (register, replace, retire), version. A family is registered once (family_exists), replaced while active
    (not_active before, retired after) by a version the family has not had (version_exists), and retired once, for good. Whether a family
    is active follows from the first register and the first retire behind it alone, so no event waits for another.
    """
    first = Window.partitionBy("family")
    registered = F.min(F.when(F.col("kind") == "register", F.col("epoch"))).over(first)
    rows = events.withColumn("__start", registered)
    retired = F.min(F.when((F.col("kind") == "retire") & (F.col("epoch") > F.col("__start")), F.col("epoch"))).over(first)
    rows = rows.withColumn("__end", retired)
    state = (
        F.when(F.col("kind") == "register", F.when(F.col("epoch") > F.col("__start"), "family_exists"))
        .when(F.col("__start").isNull() | (F.col("epoch") < F.col("__start")), "not_active")
        .when(F.col("epoch") > F.col("__end"), "retired")
    )
    rows = rows.withColumn("__state", state)
    opens = F.col("__state").isNull() & (F.col("kind") != "retire")
    used = F.row_number().over(Window.partitionBy("family", "version", opens).orderBy("epoch")) > 1
    reason = F.when(opens & (F.col("kind") == "replace") & used, "version_exists").otherwise(F.col("__state"))
    return rows.withColumn("reason", reason).drop("__start", "__end", "__state")


def group_intervals(checked: DataFrame) -> DataFrame:
    """family, version, valid_from, valid_to of the versions that accepted events open: each ends at the next accepted event."""
    taken = checked.filter("reason is null")
    spans = taken.withColumn("valid_to", F.lead("epoch").over(Window.partitionBy("family").orderBy("epoch")))
    return spans.filter("kind <> 'retire'").select("family", "version", F.col("epoch").alias("valid_from"), "valid_to")
