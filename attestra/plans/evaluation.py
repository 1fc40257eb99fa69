"""Records, metrics, baselines and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.policy import argmax_label
from ..functions.text import casefold_normalize, content_hash, fold, line_slice, relative_path
from ..operators import claims as C
from ..operators import deltas as D
from ..operators import eventlog as E
from ..operators import metrics as M
from ..operators import records as R
from ..operators import temporal as T
from ..operators.ranking import first_items
from ..session import table
from . import fixtures as X
from .fixtures import P0, P1, WITHDRAWN, with_parts
from .registry import query

Spark, Rows = SparkSession, DataFrame

# records

_SPACE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+"
_FOLDED = f"lower(regexp_replace(split, '^{_SPACE}|{_SPACE}$', '', 'g'))"


def _norm(column: str) -> str:
    return f"lower(trim(regexp_replace({column}, '{_SPACE}', ' ', 'g')))"


_EX = f"""ex AS (SELECT example_id, ingested_at, source, claim_group_id, {_norm("claim")} AS c, {_norm("evidence")} AS e, CASE {_FOLDED} WHEN 'dev' THEN 'development' ELSE {_FOLDED} END AS sp,
 lower(label) AS lab FROM verification_example)"""


def _examples(spark: Spark, folder: str) -> Rows:
    rows = table(spark, folder, "verification_example")
    split = fold(F.col("split"))
    return rows.select(
        "example_id", "ingested_at", "source", "claim_group_id", casefold_normalize(F.col("claim")).alias("c"), casefold_normalize(F.col("evidence")).alias("e"),
        F.when(split == "dev", "development").otherwise(split).alias("sp"), F.lower("label").alias("lab"),
    )


@query("SELECT p_partkey AS chunk_id, sha256(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS text_hash FROM part")
def normalized_hash(spark: Spark, folder: str) -> Rows:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("chunk_id"), content_hash(F.col("p_name")).alias("text_hash"))


@query(
    f"""WITH {_EX}, p AS (SELECT *, CASE sp WHEN 'transfer' THEN 4 WHEN 'test' THEN 3 WHEN 'development' THEN 2 WHEN 'train' THEN 1 END pr FROM ex WHERE c IS NOT NULL AND e IS NOT NULL),
b AS (SELECT *, max(pr) OVER (PARTITION BY c) best FROM p WHERE pr IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY c, e ORDER BY example_id, ingested_at) k FROM b WHERE pr = best)
SELECT example_id, sp AS split FROM f WHERE k = 1"""
)
def dedup_split_priority(spark: Spark, folder: str) -> Rows:
    rows = _examples(spark, folder).filter("c is not null and e is not null").select("example_id", "ingested_at", "c", "e", "sp")
    kept = R.keep_best_split(rows, "c", "sp", {"train": 1, "development": 2, "test": 3, "transfer": 4})
    return R.first_per(kept, ["c", "e"], ["example_id", "ingested_at"]).select("example_id", F.col("sp").alias("split"))


@query(
    f"""WITH {_EX}, a AS (SELECT * FROM ex WHERE sp = 'train'), b AS (SELECT * FROM ex WHERE sp IN ('development', 'test', 'transfer'))
SELECT 'claim' AS name, count(*) AS shared FROM (SELECT c FROM a WHERE c IS NOT NULL INTERSECT SELECT c FROM b) UNION ALL SELECT 'evidence', count(*) FROM (SELECT e FROM a WHERE e IS NOT NULL INTERSECT SELECT e FROM b)
UNION ALL SELECT 'pair', count(*) FROM (SELECT c, e FROM a WHERE c IS NOT NULL AND e IS NOT NULL INTERSECT SELECT c, e FROM b)"""
)
def overlap_counts(spark: Spark, folder: str) -> Rows:
    rows = _examples(spark, folder)
    return R.shared_counts(rows.filter("sp = 'train'"), rows.filter("sp in ('development', 'test', 'transfer')"), {"claim": ["c"], "evidence": ["e"], "pair": ["c", "e"]})


@query(
    f"""WITH {_EX}, g AS (SELECT claim_group_id g, count(DISTINCT sp) n FROM ex WHERE claim_group_id IS NOT NULL AND sp IN ('train', 'development', 'test', 'transfer') GROUP BY 1)
SELECT example_id, count(*) AS deliveries FROM ex WHERE claim_group_id IN (SELECT g FROM g WHERE n > 1) GROUP BY example_id"""
)
def quarantine(spark: Spark, folder: str) -> Rows:
    """Examples of claim groups that occur in more than one split."""
    rows = _examples(spark, folder)
    known = rows.filter("claim_group_id is not null and sp in ('train', 'development', 'test', 'transfer')")
    bad = known.groupBy("claim_group_id").agg(F.count_distinct("sp").alias("n")).filter("n > 1")
    return rows.join(bad.select("claim_group_id"), "claim_group_id", "left_semi").groupBy("example_id").agg(F.count(F.lit(1)).alias("deliveries"))


@query(
    f"""WITH {_EX} SELECT sp AS split, count(*) FILTER (lab = 'support') AS support, count(*) FILTER (lab = 'refute') AS refute, count(*) FILTER (lab = 'neutral') AS neutral, count(DISTINCT claim_group_id) AS groups FROM ex GROUP BY sp"""
)
def dataset_summary(spark: Spark, folder: str) -> Rows:
    rows = _examples(spark, folder).groupBy(F.col("sp").alias("split"))
    return rows.agg(*[F.count_if(F.col("lab") == x).alias(x) for x in M.LABELS], F.count_distinct("claim_group_id").alias("groups"))


@query("SELECT l_linenumber AS value, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark: Spark, folder: str) -> Rows:
    return table(spark, folder, "lineitem").groupBy(F.col("l_linenumber").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH d AS (SELECT p_type stratum, p_brand page, p_partkey cs, sha256('7' || chr(0) || p_type || chr(0) || p_brand || chr(0) || CAST(p_partkey AS VARCHAR)) draw FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY stratum, page ORDER BY draw, cs) k FROM d) SELECT stratum, cs AS case_id, row_number() OVER (PARTITION BY stratum ORDER BY draw, cs) AS place FROM f WHERE k = 1 QUALIFY place <= 10"""
)
def stratified_sample(spark: Spark, folder: str) -> Rows:
    part = table(spark, folder, "part").select(F.col("p_type").alias("stratum"), F.col("p_brand").alias("page"), F.col("p_partkey").alias("case_id"))
    return R.stratified_sample(part, "stratum", "page", "case_id", "7", 10).select("stratum", "case_id", "place")


@query(
    """WITH s AS (SELECT l_orderkey g, count(*) n, sha256('11' || chr(0) || CAST(l_orderkey AS VARCHAR)) draw FROM lineitem GROUP BY 1), t AS (SELECT *, sum(n) OVER (ORDER BY draw, g) total FROM s)
SELECT l_orderkey AS order_id, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT g FROM t WHERE total <= 500) GROUP BY 1"""
)
def group_bounded_sample(spark: Spark, folder: str) -> Rows:
    line = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("order_id"))
    return R.group_bounded_sample(line, "order_id", "11", 500).groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT 'g:' || claim_group_id u, 'c:' || claim v FROM verification_example WHERE claim_group_id IS NOT NULL AND claim IS NOT NULL),
n AS (SELECT DISTINCT u, v FROM (SELECT u, v FROM e UNION ALL SELECT v, u FROM e)), r AS (SELECT u node, u reached FROM n UNION SELECT r.node, n.v FROM r JOIN n ON n.u = r.reached)
SELECT substr(node, 3) AS claim_group_id, min(reached) AS component FROM r WHERE node LIKE 'g:%' GROUP BY node"""
)
def connected_components(spark: Spark, folder: str) -> Rows:
    """Claim groups that share claim texts, directly or through others."""
    rows = table(spark, folder, "verification_example").dropna(subset=["claim_group_id", "claim"])
    edges = rows.select(F.concat(F.lit("g:"), "claim_group_id").alias("a"), F.concat(F.lit("c:"), "claim").alias("b"))
    found = R.components(edges, "a", "b").filter("node like 'g:%'")
    return found.select(F.substr("node", F.lit(3)).alias("claim_group_id"), "component")


@query(
    """SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) >= 3 THEN regexp_replace(array_to_string(string_split(text, chr(10))[2:3], chr(10)), '^[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+$', '', 'g') || chr(10) END AS lines FROM documents"""
)
def line_range_extract(spark: Spark, folder: str) -> Rows:
    return table(spark, folder, "documents").select("doc_id", line_slice(F.col("text"), 2, 3).alias("lines"))


@query(
    """SELECT doc_id, CASE WHEN len(list_filter(string_split(replace(relative_path, '\\', '/'), '/'), lambda x: x IN ('', '.', '..'))) = 0 AND NOT regexp_matches(relative_path, '^[A-Za-z]:') THEN replace(relative_path, '\\', '/') END AS path FROM documents"""
)
def normalized_path(spark: Spark, folder: str) -> Rows:
    return table(spark, folder, "documents").select("doc_id", relative_path(F.col("relative_path")).alias("path"))


# metrics over scored observations: the return flag is the truth, the scores divided by their sum the probabilities

_PR = """pr AS (SELECT l_suppkey cluster, l_linestatus dom, l_linenumber line, l_orderkey cs, CASE l_returnflag WHEN 'A' THEN 'support' WHEN 'R' THEN 'refute' ELSE 'neutral' END truth,
 s / (s + r + n) ps, r / (s + r + n) pr, n / (s + r + n) pn, CASE WHEN s >= r AND s >= n THEN 'support' WHEN r >= s AND r >= n THEN 'refute' ELSE 'neutral' END pred, greatest(s, r, n) / (s + r + n) conf
 FROM (SELECT *, l_quantity / 50.0 s, l_discount * 10.0 r, l_tax * 12.5 n FROM lineitem) WHERE s + r + n > 0)"""
_P = {"support": "ps", "refute": "pr", "neutral": "pn"}


def _predictions(spark: Spark, folder: str) -> Rows:
    line = table(spark, folder, "lineitem")
    rows = line.select(
        F.col("l_suppkey").alias("cluster"), F.col("l_linestatus").alias("dom"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("cs"),
        F.when(F.col("l_returnflag") == "A", "support").when(F.col("l_returnflag") == "R", "refute").otherwise("neutral").alias("truth"),
        (F.col("l_quantity") / 50.0).alias("s"), (F.col("l_discount") * 10.0).alias("r"), (F.col("l_tax") * 12.5).alias("n"),
    )
    total = F.col("s") + F.col("r") + F.col("n")
    rows = rows.filter(total > 0).withColumn("pred", argmax_label("s", "r", "n"))
    return rows.select("cluster", "dom", "line", "cs", "truth", "pred", (F.col("s") / total).alias("ps"), (F.col("r") / total).alias("pr"), (F.col("n") / total).alias("pn"), (F.greatest("s", "r", "n") / total).alias("conf"))


@query(f"WITH {_PR} SELECT truth, pred, count(*) AS n FROM pr GROUP BY ALL")
def confusion_matrix(spark: Spark, folder: str) -> Rows:
    return M.confusion(_predictions(spark, folder), "truth", "pred")


_CLS = """cl AS (SELECT l.label, count(*) FILTER (truth = l.label AND pred = l.label) tp, count(*) FILTER (truth = l.label) t, count(*) FILTER (pred = l.label) g FROM pr, (VALUES ('support'), ('refute'), ('neutral')) l(label) GROUP BY l.label)"""


@query(f"WITH {_PR}, {_CLS} SELECT label, CASE WHEN g > 0 THEN tp / g ELSE 0 END AS precision, CASE WHEN t > 0 THEN tp / t ELSE 0 END AS recall, 2 * tp / (t + g) AS f1, t > 0 AS present FROM cl")
def class_metrics(spark: Spark, folder: str) -> Rows:
    return M.class_metrics(M.confusion(_predictions(spark, folder), "truth", "pred"), "truth", "pred")


@query(f"WITH {_PR}, {_CLS} SELECT (SELECT round(avg((truth = pred)::INT), 9) FROM pr) AS accuracy, (SELECT round(avg(2 * tp / (t + g)), 9) FROM cl WHERE t > 0) AS macro_f1")
def macro_f1(spark: Spark, folder: str) -> Rows:
    rows = M.accuracy_and_macro_f1(M.confusion(_predictions(spark, folder), "truth", "pred"), "truth", "pred")
    return rows.select(F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@query(
    f"""WITH {_PR} SELECT round(avg(power(ps - CASE WHEN truth = 'support' THEN 1 ELSE 0 END, 2) + power(pr - CASE WHEN truth = 'refute' THEN 1 ELSE 0 END, 2) + power(pn - CASE WHEN truth = 'neutral' THEN 1 ELSE 0 END, 2)), 9) AS brier,
 round(avg(-ln(greatest(CASE truth WHEN 'support' THEN ps WHEN 'refute' THEN pr ELSE pn END, 1e-15::DOUBLE))), 9) AS nll FROM pr"""
)
def brier_nll(spark: Spark, folder: str) -> Rows:
    return _predictions(spark, folder).agg(F.round(F.avg(M.brier("truth", _P)), 9).alias("brier"), F.round(F.avg(M.log_loss("truth", _P)), 9).alias("nll"))


_BIN = "CAST(" + " + ".join(f"(conf >= {k / 10}::DOUBLE)::INT" for k in range(1, 10)) + " AS INT)"


@query(f"WITH {_PR} SELECT {_BIN} AS bin, count(*) AS n, round(avg(conf), 9) AS confidence, round(avg((truth = pred)::INT), 9) AS accuracy FROM pr GROUP BY 1")
def reliability_bins(spark: Spark, folder: str) -> Rows:
    rows = _predictions(spark, folder).withColumn("ok", F.col("truth") == F.col("pred"))
    return M.reliability(rows, "conf", "ok").withColumns({c: F.round(c, 9) for c in ("confidence", "accuracy")})


@query(f"WITH {_PR}, b AS (SELECT {_BIN} AS bin, count(*) n, avg(conf) c, avg((truth = pred)::INT) a FROM pr GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 9) AS ece FROM b")
def expected_calibration_error(spark: Spark, folder: str) -> Rows:
    rows = _predictions(spark, folder).withColumn("ok", F.col("truth") == F.col("pred"))
    return M.calibration_error(M.reliability(rows, "conf", "ok")).select(F.round("ece", 9).alias("ece"))


@query(
    f"""WITH {_PR}, g AS (SELECT dom, cluster, avg(-ln(greatest(CASE truth WHEN 'support' THEN ps WHEN 'refute' THEN pr ELSE pn END, 1e-15::DOUBLE))) x FROM pr GROUP BY ALL)
SELECT round(avg(y), 9) AS balanced_loss FROM (SELECT dom, avg(x) y FROM g GROUP BY dom)"""
)
def group_balanced_nll(spark: Spark, folder: str) -> Rows:
    rows = _predictions(spark, folder).withColumn("loss", M.log_loss("truth", _P))
    return M.group_balanced_loss(rows, "dom", "cluster", "loss").select(F.round("balanced_loss", 9).alias("balanced_loss"))


def _temperature_sql(lower: float, upper: float, points: int, stages: int) -> str:
    parts, lo, width = [], f"ln({lower}::DOUBLE)", f"(ln({upper}::DOUBLE) - ln({lower}::DOUBLE))"
    for k in range(stages):
        start, span = (lo, width) if not k else (f"(SELECT x - w FROM b{k - 1})", f"(SELECT 2 * w FROM b{k - 1})")
        parts.append(f"g{k} AS (SELECT i, {start} + i * {span} / {points - 1} x, {span} / {points - 1} w FROM range({points}) t(i))")
        parts.append(f"b{k} AS (SELECT arg_min(x, l) x, any_value(w) w, min(l) l FROM (SELECT x, any_value(w) w, avg(ln(exp((a - top) / exp(x)) + exp((b - top) / exp(x)) + exp((c - top) / exp(x))) - (own - top) / exp(x)) l FROM lg, g{k} GROUP BY x))")
    return ", ".join(parts)


_SIGNAL = "lg AS (SELECT *, greatest(a, b, c) top, CASE truth WHEN 'support' THEN a WHEN 'refute' THEN b ELSE c END own FROM (SELECT ln(greatest(ps, 1e-15::DOUBLE)) * 1.5 a, ln(greatest(pr, 1e-15::DOUBLE)) * 1.5 b, ln(greatest(pn, 1e-15::DOUBLE)) * 1.5 c, CASE WHEN (cs * 7 + line * 13) % 10 < 7 THEN pred ELSE truth END truth FROM pr))"


@query(
    f"""WITH {_PR}, {_SIGNAL}, {_temperature_sql(0.05, 20.0, 33, 4)}
SELECT round(exp((SELECT x FROM b3)), 4) AS temperature, (SELECT round(avg(ln(exp(a - top) + exp(b - top) + exp(c - top)) - (own - top)), 6) FROM lg) AS nll_before, (SELECT round(l, 6) FROM b3) AS nll_after"""
)
def temperature_fit(spark: Spark, folder: str) -> Rows:
    """The fitted temperature of scores that agree with most of their labels, and the loss before and after."""
    truth = F.when((F.col("cs") * 7 + F.col("line") * 13) % 10 < 7, F.col("pred")).otherwise(F.col("truth"))
    rows = _predictions(spark, folder).select(truth.alias("truth"), *[(F.log(F.greatest(F.col(p), F.lit(M.FLOOR))) * 1.5).alias(p) for p in _P.values()])
    fitted = M.fit_temperature(rows, "truth", _P)
    return spark.createDataFrame([(round(fitted[0], 4), round(fitted[1], 6), round(fitted[2], 6))], "temperature double, nll_before double, nll_after double")


@query(
    f"""WITH {_PR}, p AS (SELECT cs, (line + 1) // 2 AS pair, bool_and(truth = pred) both_right, count(*) n, min(CASE WHEN line % 2 = 1 THEN pred END) a, min(CASE WHEN line % 2 = 0 THEN pred END) b,
 min(CASE WHEN line % 2 = 1 THEN truth END) ta, min(CASE WHEN line % 2 = 0 THEN truth END) tb FROM pr WHERE line <= 4 GROUP BY cs, (line + 1) // 2)
SELECT pair, count(*) AS pairs, count(*) FILTER (a <> b AND ta <> tb) AS flips, count(*) FILTER (both_right) AS joint_correct FROM p WHERE n = 2 AND a IS NOT NULL AND b IS NOT NULL GROUP BY pair"""
)
def transition_metrics(spark: Spark, folder: str) -> Rows:
    """Lines (1, 2) and (3, 4) of an order are the ends of its transitions."""
    rows = _predictions(spark, folder).filter("line <= 4").withColumn("pair", F.floor((F.col("line") + 1) / 2))
    odd = F.col("line") % 2 == 1
    ends = [F.min(F.when(c, F.col(x))).alias(name) for name, c, x in (("a", odd, "pred"), ("b", ~odd, "pred"), ("ta", odd, "truth"), ("tb", ~odd, "truth"))]
    both = rows.groupBy("cs", "pair").agg(F.bool_and(F.col("truth") == F.col("pred")).alias("right"), F.count(F.lit(1)).alias("n"), *ends).filter("n = 2 and a is not null and b is not null")
    return both.groupBy("pair").agg(F.count(F.lit(1)).alias("pairs"), F.count_if((F.col("a") != F.col("b")) & (F.col("ta") != F.col("tb"))).alias("flips"), F.count_if("right").alias("joint_correct"))


@query(f"WITH {_PR} SELECT cs AS case_id, count(*) AS endpoints, bool_and(truth = pred) AS all_correct FROM pr GROUP BY cs")
def case_metrics(spark: Spark, folder: str) -> Rows:
    rows = _predictions(spark, folder).groupBy(F.col("cs").alias("case_id"))
    return rows.agg(F.count(F.lit(1)).alias("endpoints"), F.bool_and(F.col("truth") == F.col("pred")).alias("all_correct"))


_EV = f"{_PR}, ev AS (SELECT cs, min(cluster) cluster, count(*) FILTER (truth = 'support' AND pred = 'support') num, count(*) FILTER (truth = 'support') den FROM pr GROUP BY cs)"


def _events(spark: Spark, folder: str) -> Rows:
    rows = _predictions(spark, folder)
    hit = F.count_if((F.col("truth") == "support") & (F.col("pred") == "support"))
    return rows.groupBy("cs").agg(F.min("cluster").alias("cluster"), hit.alias("num"), F.count_if(F.col("truth") == "support").alias("den"))


@query(
    f"""WITH {_EV} SELECT round(sum(num) / nullif(sum(den), 0), 9) AS micro, round(avg(num / nullif(den, 0)), 9) AS macro,
 (SELECT round(avg(x), 9) FROM (SELECT sum(num) / nullif(sum(den), 0) x FROM ev GROUP BY cluster)) AS cluster_macro FROM ev"""
)
def micro_macro_recall(spark: Spark, folder: str) -> Rows:
    return M.micro_macro(_events(spark, folder), "num", "den", "cluster").select(*[F.round(c, 9).alias(c) for c in ("micro", "macro", "cluster_macro")])


@query(
    f"""WITH {_EV}, c AS (SELECT cluster, sum(num)::BIGINT num, sum(den)::BIGINT den, row_number() OVER (ORDER BY cluster) - 1 i FROM ev GROUP BY cluster), k AS (SELECT count(*) n FROM c),
d AS (SELECT rep, CAST(('0x' || substr(sha256('s1' || chr(0) || CAST(rep AS VARCHAR) || chr(0) || CAST(c.i AS VARCHAR)), 1, 16))::UBIGINT % n AS BIGINT) j FROM c, k, (SELECT unnest(range(0, 25)) rep))
SELECT rep AS replicate, round(sum(num) / nullif(sum(den), 0), 9) AS value FROM d JOIN c ON c.i = d.j GROUP BY rep"""
)
def cluster_bootstrap(spark: Spark, folder: str) -> Rows:
    sums = _events(spark, folder).groupBy("cluster").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    return M.cluster_bootstrap(sums, "cluster", "num", "den", 25, "s1").withColumn("value", F.round("value", 9))


@query(
    """SELECT event_type AS kind, count(value) AS n, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90_linear, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1"""
)
def latency_percentiles(spark: Spark, folder: str) -> Rows:
    rows = table(spark, folder, "events").select(F.col("event_type").alias("kind"), "value")
    return M.percentiles(rows, ["kind"], "value").withColumns({c: F.round(c, 6) for c in ("median", "p90_linear")})


@query(
    """WITH h AS (SELECT DISTINCT chunk_version_id q, claim_id i, channel, rank, score FROM impact_channel_hit WHERE claim_id IS NOT NULL AND rank >= 1),
v AS (SELECT q, i, row_number() OVER (PARTITION BY q ORDER BY r, i) rk FROM (SELECT q, i, min(rank) r FROM h WHERE channel = 'vector' GROUP BY ALL)), w AS (SELECT DISTINCT q, i FROM h WHERE channel = 'lexical' AND rank <= 3),
g AS (SELECT q, count(*) hits, min(rk) f, sum(1 / log2(rk + 1)) dcg FROM v JOIN w USING (q, i) WHERE rk <= 10 GROUP BY q), n AS (SELECT q, count(*) rel FROM w GROUP BY q)
SELECT q AS chunk_version_id, coalesce(hits, 0) / rel AS recall, coalesce(1 / f, 0) AS reciprocal_rank, round(coalesce(dcg / list_sum(list_transform(range(1, least(rel, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 9) AS ndcg FROM n LEFT JOIN g USING (q)"""
)
def retrieval_metrics(spark: Spark, folder: str) -> Rows:
    """The vector channel's first ten claims of every chunk against the first of the lexical channel."""
    hits = table(spark, folder, "impact_channel_hit").filter("claim_id is not null and rank >= 1")
    ranked = first_items(hits.filter("channel = 'vector'").withColumn("n", F.lit(10)), ["chunk_version_id"], [("rank", True)], "claim_id", "n", "rank")
    relevant = hits.filter("channel = 'lexical' and rank <= 3").select("chunk_version_id", "claim_id")
    return M.ranking_metrics(ranked, relevant, "chunk_version_id", "claim_id", 10).withColumn("ndcg", F.round("ndcg", 9))


@query(
    """SELECT candidate_policy_id, count(*) AS hits, count(score) AS scored, CAST(sum(rank) AS BIGINT) AS rank_sum, count(rank) AS ranked, CAST(sum(CASE WHEN channel = 'learned' THEN rank END) AS BIGINT) AS learned_rank_sum FROM impact_channel_hit GROUP BY 1"""
)
def work_summary(spark: Spark, folder: str) -> Rows:
    """Sums of nullable telemetry with the numbers of observations; a sum is null if nothing was observed."""
    rows = table(spark, folder, "impact_channel_hit").groupBy("candidate_policy_id")
    return rows.agg(F.count(F.lit(1)).alias("hits"), F.count("score").alias("scored"), F.sum("rank").alias("rank_sum"), F.count("rank").alias("ranked"), F.sum(F.when(F.col("channel") == "learned", F.col("rank"))).alias("learned_rank_sum"))


@query("SELECT user_id % 7 AS seed, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1")
def seed_mean_sd(spark: Spark, folder: str) -> Rows:
    rows = table(spark, folder, "events").groupBy((F.col("user_id") % 7).alias("seed"))
    return rows.agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))


# baselines: which claims a withdrawal invalidates, against those whose status changes

_CHANGED = "ch AS (SELECT a.claim_id FROM st0 a JOIN stw b USING (claim_id) WHERE a.status <> b.status)"
_BASE = f"""src AS (SELECT DISTINCT claim_id FROM fx_obs WHERE chunk_id IN (SELECT chunk_id FROM fx_chunk WHERE document_id = '{WITHDRAWN}')),
dir AS (SELECT DISTINCT claim_id FROM dec0 WHERE document_id = '{WITHDRAWN}' AND label <> 'neutral'),
cit AS (SELECT DISTINCT s.claim_id FROM st0 s JOIN dec0 d ON d.claim_id = s.claim_id AND d.observation_id IN (s.support_least, s.refute_least) WHERE d.document_id = '{WITHDRAWN}')"""


def _baseline_sql(name: str, part: str) -> str:
    return f"SELECT '{name}' AS baseline, (SELECT count(*) FROM {part} WHERE claim_id NOT IN (SELECT claim_id FROM ch)) AS false_invalidations, (SELECT count(*) FROM ch WHERE claim_id NOT IN (SELECT claim_id FROM {part})) AS stale_exposures"


@query(
    with_parts("st0 stw fx_obs", _CHANGED + ", " + _BASE.replace("FROM fx_obs WHERE", "FROM fx_obs JOIN fx_claim USING (claim_id) WHERE") + " " + " UNION ALL ".join(_baseline_sql(n, p) for n, p in (("source", "src"), ("citation", "cit"), ("witness", "dir"))))
)
def false_invalidation(spark: Spark, folder: str) -> Rows:
    claims = X.claims(spark, folder)
    chunks = X.chunks(spark, folder).filter(F.col("document_id") == WITHDRAWN)
    rows = X.decisions(spark, folder, P0)
    after = rows.filter(F.col("document_id") != WITHDRAWN)
    changed = C.status_deltas(C.claim_statuses(claims, rows), C.claim_statuses(claims, after), "claim_id", "claim").select(F.col("object_id").alias("claim_id"))
    least = C.least_certificates(rows).select("claim_id", F.explode(F.array("support_id", "refute_id")).alias("observation_id"))
    guesses = {
        "source": X.observations(spark, folder).join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("claim_id"),
        "citation": rows.filter(F.col("document_id") == WITHDRAWN).join(least, ["claim_id", "observation_id"], "left_semi").select("claim_id"),
        "witness": rows.filter((F.col("document_id") == WITHDRAWN) & (F.col("label") != "neutral")).select("claim_id"),
    }
    out = None
    for name, guess in guesses.items():
        guess = guess.distinct().join(claims.select("claim_id"), "claim_id", "left_semi")
        part = M.false_invalidations(guess, changed, "claim_id").select(F.lit(name).alias("baseline"), "false_invalidations", "stale_exposures")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    with_parts(
        "edge",
        """sat AS (SELECT r.group_id, bool_and(e.group_id IS NOT NULL) ok FROM req r LEFT JOIN (SELECT DISTINCT group_id, ordinal FROM edge) e ON e.group_id = r.group_id AND e.ordinal = r.ordinal GROUP BY r.group_id)
SELECT group_id, ok AS conjunction FROM sat""",
    )
)
def baseline_non_distinct(spark: Spark, folder: str) -> Rows:
    """Groups all of whose requirements have some witness, whether or not one hash serves several."""
    from ..operators.matching import requirement_states

    states = requirement_states(X.requirements(spark, folder), X.edges(spark, folder))
    return states.groupBy("group_id").agg(F.bool_and("satisfied").alias("conjunction"))


@query(
    with_parts(
        "st0 st1",
        """SELECT a.claim_id, a.status AS before_status, b.status AS after_status, CASE WHEN a.status = 'supported' AND b.status <> 'supported' THEN 'lost' WHEN a.status <> 'supported' AND b.status = 'supported' THEN 'gained' ELSE 'other' END AS effect
 FROM st0 a JOIN st1 b USING (claim_id) WHERE a.status <> b.status""",
    )
)
def missed_objects(spark: Spark, folder: str) -> Rows:
    """Status effects a frozen policy would miss."""
    claims, rows = X.claims(spark, folder), X.active_current(spark, folder)
    before, after = (C.claim_statuses(claims, X.labelled(rows, p)) for p in (P0, P1))
    out = C.status_deltas(before, after, "claim_id", "claim")
    effect = F.when(F.col("old_status") == "supported", "lost").when(F.col("new_status") == "supported", "gained").otherwise("other")
    return out.select(F.col("object_id").alias("claim_id"), F.col("old_status").alias("before_status"), F.col("new_status").alias("after_status"), effect.alias("effect"))


# event log

_DIG = "sha256(concat_ws(chr(0), coalesce(update_kind, ''), coalesce(document_id, ''), coalesce(document_version_id, ''), coalesce(manifest, '')))"


@query(
    f"""WITH d AS (SELECT epoch_id, {_DIG} h FROM m4_update) SELECT epoch_id, count(*) AS deliveries, count(DISTINCT h) AS variants, CASE WHEN count(DISTINCT h) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'replayed' ELSE 'once' END AS state FROM d GROUP BY epoch_id"""
)
def event_replay_dedup(spark: Spark, folder: str) -> Rows:
    return E.replays(table(spark, folder, "m4_update"), "epoch_id", ["update_kind", "document_id", "document_version_id", "manifest"])


@query(
    """WITH e AS (SELECT user_id AS document_id, event_id AS version_id, event_type t, event_id AS valid_from, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events WHERE event_type IN ('view', 'signup', 'error'))
SELECT document_id, version_id, valid_from, valid_to FROM e WHERE t <> 'error'"""
)
def event_version_intervals(spark: Spark, folder: str) -> Rows:
    """Document versions from the event stream: views insert, signups replace, errors delete."""
    events = table(spark, folder, "events").filter("event_type in ('view', 'signup', 'error')")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.withColumn("valid_to", F.lead("event_id").over(order)).filter("event_type <> 'error'")
    return rows.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("version_id"), F.col("event_id").alias("valid_from"), "valid_to")


@query("SELECT user_id AS object_id, CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) AS BIGINT) AS overrides FROM events GROUP BY 1 HAVING overrides <> 0")
def evaluation_overlay_counters(spark: Spark, folder: str) -> Rows:
    delta = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return D.override_counters(table(spark, folder, "events").select(F.col("user_id").alias("object_id"), delta.alias("d")), "object_id", "d")


@query(
    """WITH c AS (SELECT user_id o, bool_or(event_type = 'error' AND value > 20) failed, bool_or(event_type = 'signup') scope, bool_or(event_type = 'click' AND value > 60) job FROM events GROUP BY 1)
SELECT o AS object_id, CASE WHEN failed THEN 'failed' WHEN scope THEN 'pending' WHEN job THEN 'pending' ELSE 'complete' END AS state FROM c"""
)
def evaluation_state(spark: Spark, folder: str) -> Rows:
    rows = table(spark, folder, "events").groupBy(F.col("user_id").alias("object_id"))
    t, v = F.col("event_type"), F.col("value")
    flags = rows.agg(F.bool_or((t == "error") & (v > 20)).alias("failed"), F.bool_or(t == "signup").alias("scope"), F.bool_or((t == "click") & (v > 60)).alias("job"))
    return flags.select("object_id", E.evaluation_state(F.col("failed"), F.col("scope"), F.lit(False), F.col("job")).alias("state"))


@query("SELECT event_type AS kind, count(*) AS opened, count(*) FILTER (value < 50) AS open_jobs, max(CASE WHEN value >= 50 THEN event_id END) AS last_sealed, max(event_id) AS last_seen FROM events GROUP BY 1")
def open_jobs_and_publication(spark: Spark, folder: str) -> Rows:
    """Open jobs as a count over states, and what strict (last sealed) and provisional readers see."""
    rows = table(spark, folder, "events").groupBy(F.col("event_type").alias("kind"))
    sealed = F.col("value") >= 50
    return rows.agg(F.count(F.lit(1)).alias("opened"), F.count_if(~sealed).alias("open_jobs"), F.max(F.when(sealed, F.col("event_id"))).alias("last_sealed"), F.max("event_id").alias("last_seen"))


@query(
    with_parts("fx_current fx_chunk", "SELECT c.active, count(*) AS observations, count(DISTINCT claim_id) AS claims FROM fx_current o JOIN fx_chunk c ON c.chunk_id = o.chunk_id GROUP BY c.active")
)
def late_inert_observations(spark: Spark, folder: str) -> Rows:
    """Observations on inactive chunks are stored and counted but contribute to no state."""
    rows = X.current(spark, folder).join(X.chunks(spark, folder).select("chunk_id", "active"), "chunk_id").groupBy("active")
    return rows.agg(F.count(F.lit(1)).alias("observations"), F.count_distinct("claim_id").alias("claims"))


@query(
    """WITH r AS (SELECT epoch_id, previous_published_epoch_id p FROM m4_update), d AS (SELECT DISTINCT epoch_id FROM r) SELECT epoch_id, max(p) AS previous, bool_or(p IS NOT NULL AND p NOT IN (SELECT epoch_id FROM d WHERE epoch_id IS NOT NULL)) AS dangling FROM r GROUP BY epoch_id"""
)
def epoch_chain_check(spark: Spark, folder: str) -> Rows:
    """The published predecessor each epoch names last, and whether one it names is unknown."""
    rows = table(spark, folder, "m4_update").select("epoch_id", F.col("previous_published_epoch_id").alias("p"))
    known = rows.select(F.col("epoch_id").alias("p")).dropna().distinct().withColumn("known", F.lit(True))
    joined = rows.join(known, "p", "left")
    return joined.groupBy("epoch_id").agg(F.max("p").alias("previous"), F.bool_or(F.col("p").isNotNull() & F.col("known").isNull()).alias("dangling"))
