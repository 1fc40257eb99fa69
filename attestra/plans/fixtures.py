"""The relations of the engine as projections of the given tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policy import decide
from ..functions.text import content_hash
from ..operators.temporal import latest
from ..session import table

#: The two decision policies (support threshold, refute threshold) and the withdrawn document.
P0, P1, WITHDRAWN = (0.8, 0.8), (0.6, 0.8), "Brand#11"


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return part.select(
        F.col("p_partkey").alias("chunk_id"),
        F.col("p_brand").alias("document_id"),
        F.col("p_name").alias("text"),
        content_hash(F.col("p_name")).alias("text_hash"),
        (F.col("p_size") <= 40).alias("active"),
        F.col("p_size").cast("bigint").alias("valid_from"),
        F.when(F.col("p_size") <= 30, F.col("p_size").cast("bigint") + 20).alias("valid_to"),
    )


def claims(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("answer_id"))
    first = orders.groupBy("answer_id").agg(F.min("claim_id").alias("first"))
    required = (F.col("claim_id") % 4 != 0) | (F.col("claim_id") == F.col("first"))
    return orders.join(first, "answer_id").select("claim_id", "answer_id", required.alias("required"))


def observations(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    key = F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"), F.col("l_quantity").cast("bigint")
    )
    return line.select(
        key.alias("observation_id"),
        F.col("l_orderkey").alias("claim_id"),
        F.col("l_partkey").alias("chunk_id"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_quantity") / 50.0).alias("s"),
        (F.col("l_discount") * 10.0).alias("r"),
        (F.col("l_tax") * 12.5).alias("n"),
        F.col("l_shipdate").alias("shipdate"),
        F.col("l_returnflag").alias("flag"),
    )


def current(spark: SparkSession, folder: str) -> DataFrame:
    return latest(observations(spark, folder), ["claim_id", "chunk_id"], ["shipdate", "observation_id"])


def labelled(rows: DataFrame, policy: tuple[float, float], column: str = "label") -> DataFrame:
    return rows.withColumn(column, decide("s", "r", "n", *policy))


def active_current(spark: SparkSession, folder: str, keep: str | None = None) -> DataFrame:
    """Current observations on active chunks, with the chunk's document and text hash."""
    on = chunks(spark, folder).filter("active")
    on = on if keep is None else on.filter(keep)
    return current(spark, folder).join(on.select("chunk_id", "document_id", "text_hash"), "chunk_id")


def decisions(spark: SparkSession, folder: str, policy: tuple[float, float], keep: str | None = None) -> DataFrame:
    return labelled(active_current(spark, folder, keep), policy)


def requirements(spark: SparkSession, folder: str) -> DataFrame:
    """group_id, line, ordinal: the requirements of each group, densely numbered from 0."""
    from pyspark.sql import Window

    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").alias("line")).distinct()
    ordinal = F.row_number().over(Window.partitionBy("group_id").orderBy("line")) - 1
    return lines.select("group_id", "line", ordinal.alias("ordinal"))


def edges(spark: SparkSession, folder: str, policy: tuple[float, float] = P0) -> DataFrame:
    """group_id, ordinal, text_hash, observation_id of every supporting current observation."""
    support = decisions(spark, folder, policy).filter("label = 'support'")
    support = support.select(F.col("claim_id").alias("group_id"), "line", "text_hash", "observation_id")
    return support.join(requirements(spark, folder), ["group_id", "line"]).drop("line")


def label_sql(policy: tuple[float, float]) -> str:
    return f"CASE WHEN r >= {policy[1]} AND r >= s AND r >= n THEN 'refute' WHEN s >= {policy[0]} AND s > r AND s > n THEN 'support' ELSE 'neutral' END"


def states_sql(name: str, source: str) -> str:
    return f"""{name} AS (SELECT c.claim_id, c.answer_id, c.required, count(DISTINCT text_hash) FILTER (label = 'support') support_count,
 count(DISTINCT text_hash) FILTER (label = 'refute') refute_count, max(s) FILTER (label = 'support') best_support, max(r) FILTER (label = 'refute') best_refute,
 coalesce(string_agg(observation_id, ',' ORDER BY observation_id) FILTER (label = 'support'), '') support_ids,
 coalesce(string_agg(observation_id, ',' ORDER BY observation_id) FILTER (label = 'refute'), '') refute_ids,
 min(observation_id) FILTER (label = 'support') support_least, min(observation_id) FILTER (label = 'refute') refute_least,
 CASE WHEN count(*) FILTER (label = 'support') > 0 AND count(*) FILTER (label = 'refute') > 0 THEN 'conflicted' WHEN count(*) FILTER (label = 'support') > 0 THEN 'supported'
 WHEN count(*) FILTER (label = 'refute') > 0 THEN 'refuted' ELSE 'unsupported' END status
 FROM fx_claim c LEFT JOIN {source} d ON d.claim_id = c.claim_id GROUP BY ALL)"""


def answers_sql(name: str, states: str) -> str:
    return f"""{name} AS (SELECT answer_id, count(*) required_count, count(*) FILTER (status = 'supported') supported_count, count(*) FILTER (status = 'refuted') refuted_count,
 count(*) FILTER (status = 'conflicted') conflicted_count, count(*) FILTER (status = 'unsupported') unsupported_count,
 CASE WHEN count(*) FILTER (status = 'refuted') > 0 THEN 'contradicted' WHEN count(*) FILTER (status = 'conflicted') > 0 THEN 'conflicted' WHEN count(*) FILTER (status = 'supported') = count(*) THEN 'valid'
 WHEN count(*) FILTER (status = 'supported') > 0 THEN 'partially_supported' ELSE 'unsupported' END status FROM {states} WHERE required GROUP BY answer_id)"""


SQL_PARTS = {
    "fx_chunk": """fx_chunk AS (SELECT p_partkey chunk_id, p_brand document_id, p_name AS text, sha256(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) text_hash, p_size <= 40 active,
 CAST(p_size AS BIGINT) valid_from, CASE WHEN p_size <= 30 THEN CAST(p_size AS BIGINT) + 20 END valid_to FROM part)""",
    "fx_claim": "fx_claim AS (SELECT o_orderkey claim_id, o_custkey answer_id, (o_orderkey % 4 <> 0 OR o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey)) required FROM orders)",
    "fx_obs": """fx_obs AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), CAST(l_quantity AS BIGINT)) observation_id, l_orderkey claim_id,
 l_partkey chunk_id, l_linenumber line, l_quantity / 50.0 s, l_discount * 10.0 r, l_tax * 12.5 n, l_shipdate shipdate, l_returnflag flag FROM lineitem)""",
    "fx_current": """fx_current AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, chunk_id ORDER BY shipdate DESC, observation_id DESC) rn FROM fx_obs) WHERE rn = 1)""",
    "dec0": f"dec0 AS (SELECT o.*, document_id, text_hash, {label_sql(P0)} label FROM fx_current o JOIN fx_chunk c ON c.chunk_id = o.chunk_id AND active)",
    "dec1": f"dec1 AS (SELECT o.*, document_id, text_hash, {label_sql(P1)} label FROM fx_current o JOIN fx_chunk c ON c.chunk_id = o.chunk_id AND active)",
    "decw": f"decw AS (SELECT * FROM dec0 WHERE document_id <> '{WITHDRAWN}')",
    "st0": states_sql("st0", "dec0"),
    "st1": states_sql("st1", "dec1"),
    "stw": states_sql("stw", "decw"),
    "an0": answers_sql("an0", "st0"),
    "an1": answers_sql("an1", "st1"),
    "anw": answers_sql("anw", "stw"),
    "req": "req AS (SELECT DISTINCT l_orderkey group_id, l_linenumber line, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 ordinal FROM lineitem)",
    "edge": "edge AS (SELECT group_id, ordinal, text_hash, observation_id FROM dec0 d JOIN req ON group_id = d.claim_id AND req.line = d.line WHERE label = 'support')",
}
_NEEDS = {
    "fx_current": ["fx_obs"], "dec0": ["fx_current", "fx_chunk"], "dec1": ["fx_current", "fx_chunk"], "decw": ["dec0"], "st0": ["fx_claim", "dec0"], "st1": ["fx_claim", "dec1"],
    "stw": ["fx_claim", "decw"], "an0": ["st0"], "an1": ["st1"], "anw": ["stw"], "edge": ["dec0", "req"],
}


def with_parts(names: str, body: str) -> str:
    """SQL with the named relations, and those they need, in front. ``body`` begins with SELECT or with further parts."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        need(name)
    body = body.strip()
    glue = "\n" if body.upper().startswith("SELECT") else ",\n"
    return "WITH " + ",\n".join(SQL_PARTS[n] for n in wanted) + glue + body
