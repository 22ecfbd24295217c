"""Scans, expressions, joins, aggregation, windows, sorting, set operations, recursion (inventory rows 1 to 77)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.operators import recursive, relational as R
from tessera.plans.registry import differing, pair, same
from tessera.sources import readers

FLAGSHIP = """
SELECT n_name, CAST(count(*) AS BIGINT) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'
GROUP BY n_name HAVING count(*) > 1 ORDER BY revenue DESC, n_name LIMIT 20
"""


def _join_sql(how: str) -> str:
    return f"SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer c {how} JOIN orders o ON c.c_custkey = o.o_custkey"


def _join(how: str, strategy: str | None = None):
    def run(t):
        left, right = t.customer, t.orders
        out = R.equi_join(left, right, [("c_custkey", "o_custkey")], how, strategy=strategy)
        return out.select("c_custkey", "c_name", "o_orderkey", "o_totalprice") if how not in ("semi", "anti") else out.select("c_custkey", "c_name")

    return run


_SETS = "SELECT l_returnflag AS flag, l_linestatus AS status, CAST(sum(l_quantity) AS BIGINT) AS qty, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY {g}"


def _sets(sets):
    def run(t):
        df = t.lineitem.withColumnsRenamed({"l_returnflag": "flag", "l_linestatus": "status"})
        aggs = {"qty": F.sum("l_quantity").cast("bigint"), "n": F.count(F.lit(1))}
        return R.grouping_sets(df, sets, aggs).select("flag", "status", "qty", "n")

    return run


_TREE = "SELECT CAST(n_nationkey AS BIGINT) + 100 AS id, CAST(n_regionkey AS BIGINT) + 1 AS parent_id, n_name AS name FROM nation UNION ALL SELECT CAST(r_regionkey AS BIGINT) + 1, CAST(0 AS BIGINT), r_name FROM region"


def _tree(t):
    a = t.nation.select((F.col("n_nationkey").cast("bigint") + 100).alias("id"), (F.col("n_regionkey").cast("bigint") + 1).alias("parent_id"), F.col("n_name").alias("name"))
    b = t.region.select((F.col("r_regionkey").cast("bigint") + 1).alias("id"), F.lit(0).cast("bigint").alias("parent_id"), F.col("r_name").alias("name"))
    return a.union(b)


_LINES = ["cpu,host=server01 usage=0.75 1700000000000000000", "# a comment", "mem,host=server02,zone=b used=12i,free=3i 1700000001500000000", "net up=\"yes\""]

QUERIES = {
    "flagship_revenue_per_nation": same(FLAGSHIP),
    # 2.1 scans and sources
    "scan_constant_result": pair(lambda t: R.constant_result(t.spark, ["a", "b", "c"], [42, "x", [1]]).select(F.col("a").cast("bigint").alias("a"), "b", F.col("c").cast("string").alias("c")), "SELECT CAST(42 AS BIGINT) AS a, 'x' AS b, CAST(NULL AS VARCHAR) AS c"),
    "scan_full": pair(lambda t: R.scan(t.supplier, columns=["s_suppkey", "s_name", "s_acctbal"]), "SELECT s_suppkey, s_name, s_acctbal FROM supplier"),
    "scan_point_get": pair(lambda t: R.point_get(t.orders, "o_orderkey", 77, ["o_orderkey", "o_custkey", "o_orderstatus"]), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 77"),
    "scan_index_lookup": pair(lambda t: R.scan(t.part, (F.col("p_size") == 15) & (F.col("p_partkey") > 100), order=[("p_partkey", "asc")], columns=["p_partkey", "p_name", "p_size"]), "SELECT p_partkey, p_name, p_size FROM part WHERE p_size = 15 AND p_partkey > 100 ORDER BY p_partkey"),
    "scan_index_range": pair(lambda t: R.range_scan(t.part, "p_size", 10, 20).select("p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20"),
    "scan_range_limited": pair(lambda t: R.range_scan(t.orders, "o_orderkey", 100, None, 10).select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 10"),
    "scan_count": pair(lambda t: t.lineitem.agg(F.count(F.lit(1)).alias("n")), "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem"),
    "scan_columnar_pipeline": pair(
        lambda t: R.scan(t.lineitem, F.col("l_quantity") > 45, {"net": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2), "twice": F.round(F.col("net") * 2, 2)}, [("l_orderkey", "asc"), ("l_linenumber", "asc")], limit=100, columns=["l_orderkey", "l_linenumber", "net", "twice"]),
        "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 2) AS net, round(round(l_extendedprice * (1 - l_discount), 2) * 2, 2) AS twice FROM lineitem WHERE l_quantity > 45 ORDER BY l_orderkey, l_linenumber LIMIT 100",
    ),
    "source_line_protocol": pair(
        lambda t: readers.line_protocol(t.spark.createDataFrame([(x,) for x in _LINES], "value string"), 1234).select("measurement", F.element_at("tags", "host").alias("host"), "ts", "value"),
        "SELECT * FROM (VALUES ('cpu', 'server01', CAST(1700000000000 AS BIGINT), CAST(0.75 AS DOUBLE)), ('mem', 'server02', CAST(1700000001500 AS BIGINT), CAST(12.0 AS DOUBLE)), ('net', NULL, CAST(1234 AS BIGINT), CAST(0.0 AS DOUBLE))) v(measurement, host, ts, value)",
    ),
    "source_union_rows": pair(lambda t: readers.union_rows(t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("a")), t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("b"))), "SELECT r_name AS a, CAST(NULL AS VARCHAR) AS b, r_regionkey AS k FROM region UNION ALL SELECT NULL, n_name, n_nationkey FROM nation"),
    "source_replay_dedup": pair(lambda t: t.events.select(F.col("event_type").alias("collection"), (F.col("event_id") % 500).alias("lsn")).dropDuplicates(["collection", "lsn"]), "SELECT DISTINCT event_type AS collection, event_id % 500 AS lsn FROM events"),
    # 2.2 expressions
    "expr_project_alias_reuse": same("SELECT o_orderkey, o_totalprice * 2 AS dbl, round(dbl + 1, 2) AS plus FROM orders"),
    "expr_predicates": same("SELECT c_custkey FROM customer WHERE (c_acctbal > 0 AND c_acctbal <= 5000) OR NOT (c_nationkey <> 3) OR c_mktsegment IS NULL"),
    "expr_in_between": same("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 100000 AND o_custkey NOT IN (1, 2, 3)"),
    "expr_like": differing("SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A%' OR p_name ILIKE '%E%' AND p_brand NOT LIKE 'Brand#1%'", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A%' OR p_name ILIKE '%E%' AND p_brand NOT LIKE 'Brand#1%'"),
    "expr_not_null": pair(lambda t: t.events.select("event_id", X.negated(F.nullif(F.col("event_type"), F.lit("click")) == "view").alias("flag")), "SELECT event_id, NOT (nullif(event_type, 'click') = 'view') AS flag FROM events"),
    "expr_arithmetic": same("SELECT l_orderkey, l_linenumber, -l_quantity AS neg, l_quantity % 7 AS r, l_linenumber + 2 * 3 - 1 AS x, l_returnflag || '-' || l_linestatus AS tag FROM lineitem"),
    "expr_case_coalesce_cast": same("SELECT o_orderkey, CASE WHEN o_totalprice > 50000 THEN 'big' WHEN o_totalprice > 10000 THEN 'mid' ELSE 'small' END AS size, coalesce(nullif(o_orderstatus, 'F'), 'done') AS st, CAST(o_custkey AS DOUBLE) AS d, CAST(o_orderkey AS VARCHAR(20)) AS s FROM orders"),
    "expr_array": pair(lambda t: t.nation.select("n_nationkey", F.array_join(F.array(F.col("n_name"), F.lit("x")), "|").alias("arr"), F.size(F.array(F.lit(1), F.lit(2))).cast("bigint").alias("n")), "SELECT n_nationkey, array_to_string([n_name, 'x'], '|') AS arr, CAST(2 AS BIGINT) AS n FROM nation"),
    "expr_sequence": pair(lambda t: readers.next_values(t.nation.select("n_nationkey"), [F.col("n_nationkey")], 100, 5).select("n_nationkey", F.col("nextval").cast("bigint").alias("nextval")), "SELECT n_nationkey, CAST(100 + 5 * (row_number() OVER (ORDER BY n_nationkey) - 1) AS BIGINT) AS nextval FROM nation"),
    "expr_distinct": pair(lambda t: R.scan(t.customer, columns=["c_mktsegment", "c_nationkey"], distinct=True), "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer"),
    "expr_subquery": same("SELECT c_custkey, n FROM (SELECT o_custkey AS c_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey) q WHERE n > 10 ORDER BY n DESC, c_custkey LIMIT 50"),
    "expr_cte": same("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 20000), per AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM big GROUP BY o_custkey) SELECT o_custkey, n FROM per WHERE n >= 2"),
    "doc_get": pair(lambda t: t.events.select("event_id", X.doc_get(F.col("props"), "$.k", F.lit("-1")).cast("bigint").alias("k"), X.doc_get(F.col("props"), "$.none", F.lit("dflt")).alias("d")), "SELECT event_id, CAST(coalesce(json_extract_string(props, '$.k'), '-1') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.none'), 'dflt') AS d FROM events"),
    "doc_exists": pair(lambda t: t.events.select("event_id", X.doc_exists(F.col("props"), "$.k").alias("has"), X.doc_exists(F.col("props"), "$.zz").alias("hasnt")), "SELECT event_id, json_exists(props, '$.k') AS has, json_exists(props, '$.zz') AS hasnt FROM events"),
    "doc_array_contains": pair(
        lambda t: t.events.select("event_id", X.doc_array_contains(F.concat(F.lit('{"tags":["'), F.col("event_type"), F.lit('","all"]}')), "$.tags", "click").alias("hit")),
        "SELECT event_id, event_type = 'click' AS hit FROM events",
    ),
    # 2.3 joins
    **{f"join_{h}": pair(_join(h), _join_sql(s)) for h, s in (("inner", ""), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"))},
    "join_semi": pair(_join("semi"), "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "join_anti": pair(_join("anti"), "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "join_sort_merge": pair(_join("inner", "merge"), _join_sql("")),
    "join_shuffle_hash": pair(_join("left", "shuffle_hash"), _join_sql("LEFT")),
    "join_small_side": pair(lambda t: t.supplier.join(R.small_side(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name"), "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "join_prefixed": pair(lambda t: R.equi_join(t.nation, t.region, [("n_regionkey", "r_regionkey")], aliases=("a", "b")).select("a_n_name", "b_r_name"), "SELECT n_name AS a_n_name, r_name AS b_r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_theta": pair(lambda t: R.theta_join(t.nation, t.region, F.col("n_regionkey") < F.col("r_regionkey"), "left").select("n_nationkey", "r_regionkey"), "SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON n_regionkey < r_regionkey"),
    "join_cross": pair(lambda t: R.equi_join(t.region, t.nation, []).select("r_name", "n_name"), "SELECT r_name, n_name FROM region CROSS JOIN nation"),
    "join_lateral_top_k": pair(
        lambda t: R.lateral_top_k(t.customer, t.orders, [("c_custkey", "o_custkey")], [("o_totalprice", "desc"), ("o_orderkey", "asc")], 3, "left").select("c_custkey", "o_orderkey", "o_totalprice"),
        "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) AS r FROM orders) o ON o_custkey = c_custkey AND r <= 3",
    ),
    "join_lateral_all": pair(lambda t: R.lateral_all(t.customer, t.orders, [("c_custkey", "o_custkey")], outer_row_cap=None).select("c_custkey", "o_orderkey"), "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey"),
    # 2.4 aggregation
    "agg_hash": same("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"),
    "agg_group_by_expression": same("SELECT l_linenumber % 3 AS k, CAST(count(*) AS BIGINT) AS n, CAST(max(l_orderkey) AS BIGINT) AS m FROM lineitem GROUP BY l_linenumber % 3"),
    "agg_count_nulls": same("SELECT CAST(count(*) AS BIGINT) AS a, CAST(count(nullif(o_orderstatus, 'F')) AS BIGINT) AS b FROM orders"),
    "agg_distinct": same("SELECT o_orderstatus, CAST(count(DISTINCT o_custkey) AS BIGINT) AS c, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s, round(avg(DISTINCT o_custkey), 4) AS a FROM orders GROUP BY o_orderstatus"),
    "agg_exact_sum": pair(lambda t: t.orders.agg(X.exact_sum(F.col("o_custkey").cast("decimal(38,0)") * F.lit(10**15).cast("decimal(18,0)")).cast("string").alias("s")), "SELECT CAST(sum(CAST(o_custkey AS HUGEINT) * 1000000000000000) AS VARCHAR) AS s FROM orders"),
    "agg_min_max_avg": same("SELECT n_regionkey, min(n_name) AS lo, max(n_name) AS hi, avg(n_nationkey) AS av FROM nation GROUP BY n_regionkey"),
    "agg_empty_global": same("SELECT CAST(count(*) AS BIGINT) AS n, max(o_orderkey) AS m, avg(o_totalprice) AS a FROM orders WHERE o_orderkey < 0"),
    "agg_ts_stddev": pair(lambda t: t.events.groupBy("user_id").agg(F.round(X.ts_stddev(F.col("value")), 6).alias("sd")), "SELECT user_id, round(CASE WHEN count(value) >= 2 THEN stddev_pop(value) END, 6) AS sd FROM events GROUP BY user_id"),
    "agg_filter": same("SELECT event_type, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS big, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type"),
    "agg_having": same("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 100000"),
    "agg_rollup": pair(_sets([["flag", "status"], ["flag"], []]), _SETS.format(g="ROLLUP (l_returnflag, l_linestatus)")),
    "agg_cube": pair(_sets([["flag", "status"], ["flag"], ["status"], []]), _SETS.format(g="CUBE (l_returnflag, l_linestatus)")),
    "agg_grouping_sets": pair(_sets([["flag"], ["status"]]), _SETS.format(g="GROUPING SETS ((l_returnflag), (l_linestatus))")),
    "agg_order_limit": pair(lambda t: R.aggregate(t.lineitem, ["l_suppkey"], {"q": F.sum("l_quantity")}, F.col("q") > 100, [("q", "desc"), ("l_suppkey", "asc")], 10), "SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 100 ORDER BY q DESC, l_suppkey LIMIT 10"),
    "agg_partial": pair(lambda t: R.partial_aggregate(t.orders, ["o_orderstatus"], {"n": F.count(F.lit(1))}), "SELECT true AS partial, o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus"),
    "agg_facets": pair(
        lambda t: R.facets(t.orders, ["o_orderstatus", "o_orderpriority"], 3),
        "SELECT field, value, count FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY count DESC, value) AS r FROM (SELECT 'o_orderstatus' AS field, o_orderstatus AS value, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority)) WHERE r <= 3",
    ),
    # 2.5 windows
    "window_row_number": same("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders"),
    "window_ranks": same("SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS d, CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS BIGINT) AS q FROM part"),
    "window_lag_lead": same("SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, lead(value, 2, 0.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events"),
    "window_first_last": same("SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM events"),
    "window_frame_aggregates": same("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s, CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS n FROM events"),
    "window_over_subquery": same("SELECT o_custkey, total, CAST(row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY total DESC, o_custkey) AS BIGINT) AS rn FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) q ORDER BY rn, o_custkey LIMIT 100"),
    # 2.6 sort and limit
    "sort_null_placement": pair(lambda t: R.scan(t.orders.withColumn("s", F.nullif(F.col("o_orderstatus"), F.lit("O"))), order=[("s", "desc"), ("o_orderkey", "asc")], limit=40, columns=["o_orderkey", "s"]), "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM orders ORDER BY s DESC NULLS FIRST, o_orderkey LIMIT 40"),
    "sort_limit_offset": pair(lambda t: R.scan(t.customer, order=[("c_acctbal", "desc"), ("c_custkey", "asc")], offset=20, limit=30, columns=["c_custkey", "c_acctbal"]), "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 30 OFFSET 20"),
    "sort_top_k": pair(lambda t: R.top_k(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), [("l_extendedprice", "desc"), ("l_orderkey", "asc"), ("l_linenumber", "asc")], 25), "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS FIRST, l_orderkey, l_linenumber LIMIT 25"),
    # 2.7 sets
    "set_union_all": pair(lambda t: R.union([t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select("s_nationkey")]), "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "set_union": pair(lambda t: R.union([t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select("s_nationkey")], True), "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    **{
        f"set_{name}": pair(lambda t, f=f, a=a: f(t.customer.select((F.col("c_custkey") % 40).alias("k")), t.supplier.select((F.col("s_suppkey") % 25).alias("k")), a), f"SELECT c_custkey % 40 AS k FROM customer {op} SELECT s_suppkey % 25 FROM supplier")
        for name, op, f, a in (("intersect", "INTERSECT", R.intersect, False), ("intersect_all", "INTERSECT ALL", R.intersect, True), ("except", "EXCEPT", R.except_, False), ("except_all", "EXCEPT ALL", R.except_, True))
    },
    # 2.8 recursion
    "recursive_scan": pair(lambda t: recursive.recursive_scan(_tree(t), F.col("id") == 1, ("parent_id", "id")), f"WITH RECURSIVE tree AS ({_TREE}), r AS (SELECT * FROM tree WHERE id = 1 UNION SELECT tree.* FROM tree JOIN r ON tree.parent_id = r.id) SELECT * FROM r"),
    "recursive_scan_all": pair(lambda t: recursive.recursive_scan(_tree(t), F.col("parent_id") == 0, ("parent_id", "id"), distinct=False), f"WITH RECURSIVE tree AS ({_TREE}), r AS (SELECT * FROM tree WHERE parent_id = 0 UNION ALL SELECT tree.* FROM tree JOIN r ON tree.parent_id = r.id) SELECT * FROM r"),
    "recursive_value": pair(lambda t: recursive.recursive_value(t.spark, "n", "1", "n + 1", "n < 10").select(F.col("n").cast("bigint").alias("n")), "WITH RECURSIVE r(n) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT n + 1 FROM r WHERE n < 10) SELECT n FROM r"),
}
