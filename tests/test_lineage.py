import duckdb
from compare import check_query

from attestra.plans import all_queries, all_sql

PART = """SELECT * FROM (VALUES (1, 'a', 'B1', 50), (2, 'a', 'B1', 10), (3, 'a', 'B1', 10), (3, 'b', 'B1', 10), (3, 'b', 'B1', 10), (4, 'b', 'B1', 45), (5, 'b', 'B2', 10),
 (6, NULL, 'B1', 50), (7, NULL, 'B1', 10), (8, 'a', 'B1', NULL), (NULL, 'a', 'B1', 10), (1, 'b', 'B1', 50)) t(p_partkey, p_name, p_brand, p_size)"""
LINE = """SELECT k AS l_orderkey, c AS l_partkey, 1 AS l_suppkey, 1 AS l_linenumber, 10.0::DOUBLE l_quantity, 0.1::DOUBLE l_discount, 0.1::DOUBLE l_tax, 'N' AS l_returnflag,
 TIMESTAMP '2025-01-01' + INTERVAL (d) DAY l_shipdate FROM (VALUES (10, 1, 1), (10, 1, 2), (10, 4, 1), (11, 4, 1), (12, 2, 1), (NULL, 1, 1), (13, NULL, 1), (14, 6, 1)) t(k, c, d)"""


def test_lineage_pairs_are_distinct_without_a_shuffle_of_the_pairs(spark, tmp_path):
    duck = duckdb.connect()
    for name, sql in (("part", PART), ("lineitem", LINE)):
        duck.execute(f"CREATE TABLE {name} AS {sql}")
        duck.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    check_query(all_queries()["lineage_pairs"], all_sql()["lineage_pairs"], spark, duck, str(tmp_path))
    plan = all_queries()["lineage_pairs"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union"  # a chunk of one place is not made distinct again
