"""Certificates, Hall counts and persisted images under change: groups of up to four requirements with many observations an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import certificates as K
from ..operators import matching as M
from ..operators import temporal as T
from ..session import table
from .registry import query

Spark, Rows = SparkSession, DataFrame


def _observations(spark: Spark, folder: str) -> Rows:
    """group_id, ordinal, text_hash, observation_id, before and after: whether the observation lives before and after the change."""
    line = table(spark, folder, "lineitem")
    air, rail, quantity = F.col("l_suppkey") % 7 == 0, F.col("l_suppkey") % 7 == 1, F.col("l_quantity")
    return line.select(
        F.floor(F.col("l_orderkey") / 4).alias("group_id"), ((F.col("l_linenumber") - 1) % 4).cast("int").alias("ordinal"), F.concat(F.lit("h"), (F.col("l_partkey") % 9).cast("string")).alias("text_hash"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("observation_id"), (quantity >= 12).alias("before"), (((quantity >= 12) & ~air) | ((quantity >= 8) & rail)).alias("after"),
        (F.col("l_returnflag") == "A").alias("direct"),
    )


_TR = """tr AS (SELECT l_orderkey // 4 AS group_id, CAST((l_linenumber - 1) % 4 AS INT) ordinal, 'h' || CAST(l_partkey % 9 AS VARCHAR) text_hash, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) observation_id,
 l_quantity >= 12 AS b, (l_quantity >= 12 AND l_suppkey % 7 <> 0) OR (l_quantity >= 8 AND l_suppkey % 7 = 1) AS a, l_returnflag = 'A' AS direct FROM lineitem),
rq AS (SELECT DISTINCT group_id, ordinal FROM tr), rn AS (SELECT group_id, CAST(count(*) AS INT) r FROM rq GROUP BY 1),
pc AS (SELECT group_id, ordinal, min(text_hash) h FROM tr WHERE b GROUP BY ALL), ok AS (SELECT group_id FROM pc JOIN rn USING (group_id) GROUP BY group_id, r HAVING count(*) = r AND count(DISTINCT h) = r),
c0 AS (SELECT pc.group_id, pc.ordinal, h AS text_hash, min(observation_id) observation_id FROM pc JOIN ok USING (group_id) JOIN tr ON tr.group_id = pc.group_id AND tr.ordinal = pc.ordinal AND tr.text_hash = h AND b GROUP BY ALL)"""
_SUB = """sb AS (SELECT group_id, s AS subset FROM rn, (SELECT unnest(range(1, 16)) s) WHERE s < (1 << r)), ma AS (SELECT group_id, text_hash, CAST(bit_or(1 << ordinal) AS INT) m FROM tr WHERE a GROUP BY ALL), mb AS (SELECT group_id, text_hash, CAST(bit_or(1 << ordinal) AS INT) m FROM tr WHERE b GROUP BY ALL),
ha AS (SELECT sb.group_id, subset, count(DISTINCT text_hash) n FROM sb LEFT JOIN ma ON ma.group_id = sb.group_id AND (m & CAST(subset AS INT)) <> 0 GROUP BY ALL), hb AS (SELECT sb.group_id, subset, count(DISTINCT text_hash) n FROM sb LEFT JOIN mb ON mb.group_id = sb.group_id AND (m & CAST(subset AS INT)) <> 0 GROUP BY ALL),
ca AS (SELECT group_id FROM ha GROUP BY 1 HAVING bool_and(n >= bit_count(CAST(subset AS INT))))"""
_ACT = """w AS (SELECT c0.*, (SELECT min(observation_id) FROM tr WHERE a AND tr.group_id = c0.group_id AND tr.ordinal = c0.ordinal AND tr.text_hash = c0.text_hash) least,
 EXISTS (SELECT 1 FROM tr WHERE a AND tr.group_id = c0.group_id AND tr.ordinal = c0.ordinal AND tr.text_hash = c0.text_hash AND tr.observation_id = c0.observation_id) alive FROM c0),
ac AS (SELECT group_id, count(*) FILTER (NOT alive AND least IS NOT NULL) repairs, count(*) FILTER (least IS NULL) lost, group_id IN (SELECT group_id FROM ca) AS still FROM w GROUP BY group_id),
tx AS (SELECT group_id, CASE WHEN lost = 0 AND repairs = 0 THEN 'retain' WHEN lost = 0 THEN 'repair' WHEN still THEN 'rebuild' ELSE 'close' END AS action, repairs, lost FROM ac)"""


class _Case:
    """The relations of one change: observations and edges before and after, requirements, and the certificates before it."""

    def __init__(self, spark: Spark, folder: str):
        rows = _observations(spark, folder)
        self.requirements = rows.select("group_id", "ordinal").distinct()
        self.before, self.after = (rows.filter(x).select("group_id", "ordinal", "text_hash", "observation_id", "direct") for x in ("before", "after"))
        self.sizes = M.group_sizes(self.requirements)

    def certificates(self) -> Rows:
        """Certificates of the groups whose least hashes already are a matching: one that any engine finds."""
        least = self.before.groupBy("group_id", "ordinal").agg(F.min(F.struct("text_hash", "observation_id")).alias("x")).select("group_id", "ordinal", "x.*")
        good = least.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text_hash").alias("h")).join(self.sizes, "group_id").filter("n = r and h = r")
        return least.join(good.select("group_id"), "group_id", "left_semi")

    def complete(self) -> Rows:
        return M.group_states(self.requirements, self.after).filter("complete").select("group_id")

    def transitions(self, rebind: bool = False) -> Rows:
        return K.transitions(self.certificates(), self.after, self.complete(), rebind)

    def moved_masks(self) -> Rows:
        refcounts = self.before.groupBy("group_id", "ordinal", "text_hash").agg(F.count(F.lit(1)).alias("n"))
        signed = self.before.withColumn("delta", F.lit(-1)).unionByName(self.after.withColumn("delta", F.lit(1)))
        return M.mask_transitions(M.coalesce_edge_deltas(refcounts, signed), self.before)


@query(f"WITH {_TR}, {_SUB}, {_ACT} SELECT group_id, action, repairs, lost FROM tx")
def certificate_transitions(spark: Spark, folder: str) -> Rows:
    return _Case(spark, folder).transitions()


@query(f"WITH {_TR}, {_SUB}, {_ACT} SELECT group_id, CASE action WHEN 'retain' THEN 'rebind' WHEN 'repair' THEN 'rebind_repair' ELSE action END AS action, repairs, lost FROM tx")
def certificate_rebind(spark: Spark, folder: str) -> Rows:
    """The same change under a new decision policy, which every certificate that stays has to name."""
    return _Case(spark, folder).transitions(rebind=True)


@query(f"WITH {_TR}, {_SUB}, {_ACT} SELECT group_id, ordinal, text_hash, CASE WHEN alive THEN observation_id ELSE least END AS observation_id, NOT alive AS replaced FROM w WHERE group_id IN (SELECT group_id FROM tx WHERE lost = 0)")
def certificate_repair(spark: Spark, folder: str) -> Rows:
    case = _Case(spark, folder)
    return K.repaired(case.certificates(), case.after)


_BIND = """bd AS (SELECT group_id, 1 AS artifact, 0 AS from_revision, CASE WHEN action <> 'retain' THEN 5 END AS to_revision FROM tx UNION ALL SELECT group_id, 2, 5, NULL FROM tx WHERE action IN ('repair', 'rebuild'))"""


@query(f"WITH {_TR}, {_SUB}, {_ACT}, {_BIND} SELECT group_id, artifact, from_revision, to_revision FROM bd")
def certificate_bindings(spark: Spark, folder: str) -> Rows:
    return K.bindings(_Case(spark, folder).transitions(), 5)


@query(
    f"""WITH {_TR}, {_SUB}, {_ACT}, {_BIND}, hs AS (SELECT 1 AS epoch, * FROM bd UNION ALL SELECT 2, group_id, 3, 4, NULL FROM tx WHERE group_id % 3 = 0 AND action <> 'close'),
n AS (SELECT * FROM hs WHERE epoch = 2 AND from_revision <= 6), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY epoch DESC, from_revision DESC) k FROM hs WHERE epoch < 2) WHERE k = 1 AND to_revision IS NULL)
SELECT group_id, epoch, artifact FROM n UNION ALL SELECT group_id, epoch, artifact FROM f WHERE group_id NOT IN (SELECT group_id FROM n)"""
)
def certificate_carry_forward(spark: Spark, folder: str) -> Rows:
    """Bindings in force in the next epoch, which rebinds every third group: the others carry the open binding of the epoch before."""
    history = K.bindings(_Case(spark, folder).transitions(), 5).withColumn("epoch", F.lit(1))
    again = history.filter("to_revision is null and group_id % 3 = 0").withColumns({"epoch": F.lit(2), "artifact": F.lit(3), "from_revision": F.lit(4).cast("bigint")})
    return K.effective_bindings(history.unionByName(again), "group_id", 2, 6).select("group_id", "epoch", "artifact")


@query(
    f"""WITH {_TR}, {_SUB}, cb0 AS (SELECT group_id FROM hb GROUP BY 1 HAVING bool_and(n >= bit_count(CAST(subset AS INT)))),
o AS (SELECT group_id, coalesce('direct:' || (SELECT min(observation_id) FROM tr WHERE tr.group_id = rn.group_id AND b AND direct), CASE WHEN group_id IN (SELECT group_id FROM cb0) THEN 'group:' || CAST(group_id AS VARCHAR) END) old_ref,
 coalesce('direct:' || (SELECT min(observation_id) FROM tr WHERE tr.group_id = rn.group_id AND a AND direct), CASE WHEN group_id IN (SELECT group_id FROM ca) THEN 'group:' || CAST(group_id AS VARCHAR) END) new_ref FROM rn)
SELECT group_id AS claim_id, CASE WHEN old_ref IS NULL THEN 'open' WHEN new_ref IS NULL THEN 'close' WHEN old_ref = new_ref THEN 'retain' ELSE 'replace' END AS action, old_ref, new_ref FROM o WHERE old_ref IS NOT NULL OR new_ref IS NOT NULL"""
)
def claim_binding_transitions(spark: Spark, folder: str) -> Rows:
    case = _Case(spark, folder)
    claims = case.requirements.select(F.col("group_id").alias("claim_id")).distinct()

    def certificates(rows: Rows) -> Rows:
        least = rows.filter("direct").groupBy(F.col("group_id").alias("claim_id")).agg(F.min("observation_id").alias("support_id")).withColumn("refute_id", F.lit(None).cast("string"))
        complete = M.group_states(case.requirements, rows).filter("complete")
        return M.combined_certificates(claims, least, complete.select(F.col("group_id").alias("claim_id"), "group_id"))

    return K.claim_transitions(certificates(case.before), certificates(case.after))


@query(f"WITH {_TR}, {_SUB} SELECT group_id, subset, hb.n AS before, ha.n AS after FROM hb JOIN ha USING (group_id, subset) WHERE hb.n <> ha.n")
def hall_transition(spark: Spark, folder: str) -> Rows:
    case = _Case(spark, folder)
    counts = M.hall_subsets(case.requirements, case.before).select("group_id", "subset", "neighbours")
    return K.moved_subsets(counts, K.subset_deltas(case.moved_masks(), case.sizes))


@query(f"WITH {_TR}, {_SUB} SELECT 'hall' AS family, count(*) AS persisted, count(*) AS replayed, 0 AS mismatches FROM ha")
def hall_audit(spark: Spark, folder: str) -> Rows:
    """Subset counts moved by transitions against counts made anew."""
    case = _Case(spark, folder)
    counts = M.hall_subsets(case.requirements, case.before).select("group_id", "subset", "neighbours")
    moved = K.subset_deltas(case.moved_masks(), case.sizes)
    kept = counts.join(moved, ["group_id", "subset"], "left").select("group_id", "subset", (F.col("neighbours") + F.coalesce("delta", F.lit(0))).alias("neighbours"))
    return K.image_mismatches(kept, M.hall_subsets(case.requirements, case.after).select("group_id", "subset", "neighbours"), ["group_id", "subset"], "hall")


@query(f"WITH {_TR}, {_SUB} SELECT group_id, '0,' || string_agg(CAST(n AS VARCHAR), ',' ORDER BY subset) AS neighbours FROM hb GROUP BY group_id")
def matching_image(spark: Spark, folder: str) -> Rows:
    case = _Case(spark, folder)
    return K.hall_arrays(M.hall_subsets(case.requirements, case.before))


@query(
    f"""WITH {_TR}, {_SUB} SELECT group_id, CASE group_id % 4 WHEN 1 THEN 'wrong_length' WHEN 2 THEN 'bad_start' ELSE 'negative' END AS reason FROM rn WHERE group_id % 4 <> 0"""
)
def hall_array_check(spark: Spark, folder: str) -> Rows:
    """Stored arrays that cannot be counts; three of four groups carry a planted fault."""
    case = _Case(spark, folder)
    arrays = K.hall_arrays(M.hall_subsets(case.requirements, case.before))
    kind = F.col("group_id") % 4
    broken = F.when(kind == 1, F.concat("neighbours", F.lit(",0"))).when(kind == 2, F.regexp_replace("neighbours", "^0,", "1,")).when(kind == 3, F.regexp_replace("neighbours", ",[0-9]+$", ",-1"))
    return K.invalid_arrays(arrays.withColumn("neighbours", F.coalesce(broken, F.col("neighbours"))), case.sizes)


@query(
    f"""WITH {_TR}, ed AS (SELECT DISTINCT group_id, ordinal, text_hash FROM tr WHERE b UNION SELECT group_id, k, '#' || CAST(k AS VARCHAR) FROM rn, (SELECT unnest(range(0, 4)) k) WHERE k >= r)
SELECT rn.group_id, (SELECT count(*) FROM ed x JOIN ed y ON y.group_id = x.group_id AND y.ordinal = 1 AND y.text_hash <> x.text_hash JOIN ed z ON z.group_id = x.group_id AND z.ordinal = 2 AND z.text_hash NOT IN (x.text_hash, y.text_hash)
 JOIN ed u ON u.group_id = x.group_id AND u.ordinal = 3 AND u.text_hash NOT IN (x.text_hash, y.text_hash, z.text_hash) WHERE x.group_id = rn.group_id AND x.ordinal = 0) AS perfect FROM rn"""
)
def perfect_matchings(spark: Spark, folder: str) -> Rows:
    case = _Case(spark, folder)
    return K.perfect_matchings(case.requirements, M.hash_masks(case.before))


@query(
    f"""WITH {_TR}, x AS (SELECT group_id, ordinal, text_hash, count(*) FILTER (a AND NOT b) added, count(*) FILTER (b AND NOT a) removed, min(observation_id) FILTER (b) least_before, min(observation_id) FILTER (a) least_after FROM (SELECT group_id, ordinal, text_hash, observation_id, bool_or(a) a, bool_or(b) b FROM tr GROUP BY ALL) GROUP BY ALL)
SELECT * FROM x WHERE added > 0 OR removed > 0"""
)
def observation_index_changes(spark: Spark, folder: str) -> Rows:
    case = _Case(spark, folder)
    return K.observation_index_changes(case.before, case.after)


def _promoted(case: _Case) -> Rows:
    """The published reference counts of edges with the working rows of the change over them; a count of 0 is a tombstone."""
    key = ["group_id", "ordinal", "text_hash"]
    published = case.before.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    signed = case.before.withColumn("delta", F.lit(-1)).unionByName(case.after.withColumn("delta", F.lit(1)))
    working = M.coalesce_edge_deltas(published, signed).select(*key, F.col("after").alias("n"))
    return T.overlay(published, working, key, F.col("n") == 0)


@query(f"WITH {_TR} SELECT group_id, ordinal, text_hash, count(*) AS n FROM tr WHERE a GROUP BY ALL")
def matching_overlay_promotion(spark: Spark, folder: str) -> Rows:
    return _promoted(_Case(spark, folder))


@query(
    f"""WITH {_TR}, {_SUB} SELECT 'edge' AS family, count(*) AS persisted, count(*) AS replayed, 0 AS mismatches FROM (SELECT DISTINCT group_id, ordinal, text_hash FROM tr WHERE a)
UNION ALL SELECT 'mask', count(*), count(*), 0 FROM ma UNION ALL SELECT 'hall', count(*), count(*), 0 FROM rn"""
)
def physical_image_audit(spark: Spark, folder: str) -> Rows:
    """The promoted image of edges, masks and Hall arrays against one replayed from the observations."""
    case = _Case(spark, folder)
    key = ["group_id", "ordinal", "text_hash"]
    image, replay = _promoted(case), case.after.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    edges = K.image_mismatches(image, replay, key, "edge")
    masks = K.image_mismatches(M.hash_masks(image), M.hash_masks(case.after), ["group_id", "text_hash"], "mask")
    arrays = [K.hall_arrays(M.hall_subsets(case.requirements, x)) for x in (image, case.after)]
    return edges.unionByName(masks).unionByName(K.image_mismatches(*arrays, ["group_id"], "hall"))


_GE = """ge AS (SELECT epoch_id AS epoch, document_id AS family, CASE kind WHEN 'insert' THEN 'register' WHEN 'replace' THEN 'replace' ELSE 'retire' END AS kind, version FROM
 (SELECT epoch_id, document_id, kind, v AS version, row_number() OVER (PARTITION BY epoch_id ORDER BY p DESC NULLS LAST, document_id DESC, kind DESC, v DESC NULLS LAST) k FROM (SELECT epoch_id, document_id, lower(trim(update_kind, ' \t\n\r')) kind, document_version_id v, previous_published_epoch_id p FROM m4_update WHERE epoch_id IS NOT NULL AND document_id IS NOT NULL) WHERE kind IN ('insert', 'replace', 'delete')) WHERE k = 1),
g1 AS (SELECT *, min(epoch) FILTER (kind = 'register') OVER (PARTITION BY family) s FROM ge), g2 AS (SELECT *, min(epoch) FILTER (kind = 'retire' AND epoch > s) OVER (PARTITION BY family) e FROM g1),
g3 AS (SELECT *, CASE WHEN kind = 'register' THEN CASE WHEN epoch > s THEN 'family_exists' END WHEN s IS NULL OR epoch < s THEN 'not_active' WHEN epoch > e THEN 'retired' END st FROM g2),
g4 AS (SELECT *, CASE WHEN st IS NULL AND kind = 'replace' AND EXISTS (SELECT 1 FROM g3 y WHERE y.family = x.family AND y.version IS NOT DISTINCT FROM x.version AND y.st IS NULL AND y.kind <> 'retire' AND y.epoch < x.epoch) THEN 'version_exists' ELSE st END AS reason FROM g3 x)"""


def _group_events(spark: Spark, folder: str) -> Rows:
    """The change feed as events on group families: insert registers, replace replaces, delete retires."""
    from .pipeline import applied_epochs

    kind = F.when(F.col("kind") == "insert", "register").when(F.col("kind") == "replace", "replace").otherwise("retire")
    return applied_epochs(spark, folder).select(F.col("epoch_id").alias("epoch"), F.col("document_id").alias("family"), kind.alias("kind"), F.col("document_version_id").alias("version"))


@query(f"WITH {_GE} SELECT epoch, family, kind, version, reason FROM g4")
def group_events(spark: Spark, folder: str) -> Rows:
    return K.group_events(_group_events(spark, folder))


@query(f"WITH {_GE}, v AS (SELECT *, lead(epoch) OVER (PARTITION BY family ORDER BY epoch) n FROM g4 WHERE reason IS NULL) SELECT family, version, epoch AS valid_from, n AS valid_to FROM v WHERE kind <> 'retire'")
def group_version_intervals(spark: Spark, folder: str) -> Rows:
    return K.group_intervals(K.group_events(_group_events(spark, folder)))


@query(f"WITH {_GE} SELECT epoch, family, version, reason FROM g4 WHERE kind = 'replace' AND reason IS NOT NULL")
def replace_validation(spark: Spark, folder: str) -> Rows:
    """Replacements that are refused: nothing active to replace, or a version that was there before."""
    return K.group_events(_group_events(spark, folder)).filter("kind = 'replace' and reason is not null").select("epoch", "family", "version", "reason")


@query(
    f"""WITH {_GE}, v AS (SELECT *, lead(epoch) OVER (PARTITION BY family ORDER BY epoch) n FROM g4 WHERE reason IS NULL), o AS (SELECT family, version, epoch f, n t FROM v WHERE kind <> 'retire')
SELECT family, version FROM o WHERE f <= 200 AND (t IS NULL OR t > 200) AND family NOT IN (SELECT family FROM ge WHERE epoch > 200 AND epoch <= 260) UNION ALL
SELECT family, arg_max(version, epoch) FROM g4 WHERE reason IS NULL AND epoch > 200 AND epoch <= 260 GROUP BY family HAVING arg_max(kind, epoch) <> 'retire'
UNION ALL SELECT family, version FROM o WHERE f <= 200 AND (t IS NULL OR t > 200) AND family IN (SELECT family FROM ge WHERE epoch > 200 AND epoch <= 260) AND family NOT IN (SELECT family FROM g4 WHERE reason IS NULL AND epoch > 200 AND epoch <= 260)"""
)
def effective_group_versions(spark: Spark, folder: str) -> Rows:
    """Group versions as of epoch 200 with the accepted events of the epochs up to 260 staged over them; retired families are tombstones."""
    checked = K.group_events(_group_events(spark, folder))
    base = T.as_of(K.group_intervals(checked), 200).select("family", "version")
    staged = T.latest(checked.filter("reason is null and epoch > 200 and epoch <= 260").select("family", "epoch", "kind", "version"), ["family"], ["epoch"])
    return T.overlay(base, staged, ["family"], F.col("kind") == "retire")
