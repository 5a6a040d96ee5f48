"""One query per feature of the dialect on the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import engine
from tidemill.plans.nodes import NestedLoopJoin
from tidemill.plans.stats import table_stats
from tidemill.runtime import working_path
from tidemill.sources.catalog import Catalog
from tidemill.sources.snapshots import SnapshotTable

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
NULL_ROWS = [(1, "a", 1.5), (None, "a", None), (2, None, 2.5), (None, None, None), (3, "b", 0.0), (3, "b", -1.0)]
_NULLS = "(SELECT CAST(k AS BIGINT) AS k, g, CAST(v AS DOUBLE) AS v FROM (VALUES (1, 'a', 1.5), (NULL, 'a', NULL), (2, NULL, 2.5), (NULL, NULL, NULL), (3, 'b', 0.0), (3, 'b', -1.0)) AS r(k, g, v)) AS n"


def catalog(spark: SparkSession, d: str) -> Catalog:
    out = Catalog(spark)
    for name in TABLES:
        out.load_parquet(name, f"{d}/{name}.parquet")
    return out


# name: (dialect text, oracle SQL or None where the text itself is the SQL, engine options)
TEXTS: dict[str, tuple[str, str | None, dict]] = {}


def _add(name: str, text: str, oracle: str | None = None, **options) -> None:
    TEXTS[name] = (text, oracle, options)


_add("scan_project", "SELECT o_orderkey, o_orderstatus FROM orders")
_add("filter_eq", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
_add("filter_ne", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey != 3")
_add("filter_lt", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10")
_add("filter_gt", "SELECT p_partkey FROM part WHERE p_retailprice > 950.5")
_add("filter_le", "SELECT s_suppkey FROM supplier WHERE s_acctbal <= 0")
_add("filter_ge", "SELECT s_suppkey, s_name FROM supplier WHERE s_name >= 'Supplier#000000050'")
_add("filter_and", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 AND o_custkey < 1000")
_add("filter_or", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_custkey < 100")
_add("filter_not", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_custkey < 100)")
_add("filter_nested", "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_nationkey = 7) AND NOT (c_acctbal < 0 AND NOT c_nationkey = 7)")
_add("filter_truthy", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <> 0")
_add("filter_time", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1997-01-01'")
_add("filter_mixed_types", "SELECT c_custkey FROM customer WHERE NOT c_mktsegment = 1 AND c_custkey = 5.0", "SELECT c_custkey FROM customer WHERE c_custkey = 5")
_add("bool_projection", "SELECT o_orderkey, (o_orderstatus = 'F') AS is_f FROM orders")
_add("literal_projection", "SELECT n_nationkey, 1 AS one, 'x' AS x, 2.5 AS h FROM nation", "SELECT n_nationkey, CAST(1 AS BIGINT) AS one, 'x' AS x, CAST(2.5 AS DOUBLE) AS h FROM nation")
_add("join_two", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
_add("join_three", "SELECT c.c_custkey AS c, o.o_orderkey AS o, l.l_linenumber AS l FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity > 45")
_add(
    "join_star_filtered",
    "SELECT c.c_custkey AS c, n.n_name AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'",
)
_add("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
_add("join_extra_equality", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_custkey = s_suppkey")
_add("join_cross_table_or", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F' OR c_mktsegment = 'BUILDING'")
_add("join_cross_table_and_in_or", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE (o_orderstatus = 'F' AND c_mktsegment = 'BUILDING') OR c_nationkey = 1")
_add("join_constant_key", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = 1", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = 1")
_THREE = "SELECT c.c_mktsegment AS s, COUNT(*) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 2 AND o.o_orderstatus = 'F' GROUP BY c.c_mktsegment"
_add("pushdown_off", _THREE, pushdown=False)
_add("reorder_off", _THREE, reorder=False)
_add("toggles_on", _THREE)
_add("join_unqualified", "SELECT c_custkey FROM customer JOIN nation ON (n_nationkey = c_nationkey)")
_add("join_same_names", "SELECT a.r_name AS r FROM region a JOIN region b ON r_regionkey = r_regionkey", "SELECT r_name AS r FROM region")
_add("default_names", "SELECT COUNT(*), SUM(s_nationkey), o.s_name FROM supplier o GROUP BY o.s_name", 'SELECT COUNT(*) AS "COUNT(*)", CAST(SUM(s_nationkey) AS BIGINT) AS "SUM(s_nationkey)", s_name AS "o.s_name" FROM supplier GROUP BY s_name')
_add("filter_truthy_text", "SELECT o_orderkey FROM orders WHERE o_orderstatus AND o_orderdate AND NOT o_custkey", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> '' AND o_orderdate IS NOT NULL AND coalesce(o_custkey = 0, true)")
_add("join_text_and_time", "SELECT a.e AS e FROM times a JOIN texts b ON a.t = b.t", "SELECT CAST(e AS BIGINT) AS e FROM (VALUES (1)) AS v(e)")
_add(
    "agg_global",
    "SELECT COUNT(*) AS n, COUNT(o_custkey) AS c, SUM(o_custkey) AS s, MIN(o_totalprice) AS lo, MAX(o_orderstatus) AS hi, AVG(o_custkey) AS a FROM orders",
    "SELECT COUNT(*) AS n, COUNT(o_custkey) AS c, CAST(SUM(o_custkey) AS BIGINT) AS s, MIN(o_totalprice) AS lo, MAX(o_orderstatus) AS hi, AVG(o_custkey) AS a FROM orders",
)
_add("agg_empty", "SELECT COUNT(*) AS n, SUM(o_custkey) AS s, AVG(o_custkey) AS a FROM orders WHERE o_custkey < 0", "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, AVG(o_custkey) AS a FROM orders WHERE o_custkey < 0")
_add("agg_group", "SELECT l_returnflag, COUNT(*) AS n, SUM(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
_add("agg_group_multi", "SELECT l_returnflag, l_linestatus, MIN(l_quantity) AS lo, MAX(l_shipdate) AS hi, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
_add("agg_unselected_key", "SELECT COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
_add("group_no_agg", "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment, c_nationkey")
_add("group_constant", "SELECT COUNT(*) AS n FROM orders GROUP BY 1", "SELECT COUNT(*) AS n FROM orders")
_add("agg_bool", "SELECT SUM((o_orderstatus = 'F')) AS f, COUNT((o_orderstatus = 'F')) AS n, MAX((o_custkey = 1)) AS m FROM orders", "SELECT COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, COUNT(*) AS n, bool_or(o_custkey = 1) AS m FROM orders")
_add("sort_multi", "SELECT c_nationkey, c_custkey FROM customer ORDER BY c_nationkey DESC, c_custkey")
_add("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_add("topk_unselected_key", "SELECT o_orderstatus, o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
_add("limit_ordered", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 7")
_add("limit_zero", "SELECT p_partkey FROM part LIMIT 0")
_add("distinct_one", "SELECT DISTINCT o_orderpriority FROM orders")
_add("distinct_multi", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
_add("distinct_order", "SELECT DISTINCT c_mktsegment AS s FROM customer ORDER BY s LIMIT 3")
_add(
    "agg_join_topk",
    "SELECT c.c_mktsegment AS segment, COUNT(*) AS n, MAX(l.l_extendedprice) AS top FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderstatus = 'F' GROUP BY c.c_mktsegment ORDER BY n DESC, segment LIMIT 3",
)
_add("null_not", "SELECT k, g FROM n WHERE NOT k = 1", f"SELECT k, g FROM {_NULLS} WHERE NOT coalesce(k = 1, false)")
_add("null_not_nested", "SELECT k, v FROM n WHERE NOT (k = 1 OR NOT g = 'a')", f"SELECT k, v FROM {_NULLS} WHERE NOT (coalesce(k = 1, false) OR NOT coalesce(g = 'a', false))")
_add("null_bool", "SELECT k, (k = 1) AS b, (NOT g = 'a') AS c FROM n", f"SELECT k, coalesce(k = 1, false) AS b, NOT coalesce(g = 'a', false) AS c FROM {_NULLS}")
_add("null_order", "SELECT k, v FROM n ORDER BY k DESC, v DESC LIMIT 4", f"SELECT k, v FROM {_NULLS} ORDER BY k DESC NULLS LAST, v DESC NULLS LAST LIMIT 4")
_add("null_group", "SELECT g, COUNT(*) AS n, COUNT(k) AS k, SUM(v) AS s FROM n GROUP BY g", f"SELECT g, COUNT(*) AS n, COUNT(k) AS k, CAST(SUM(v) AS DOUBLE) AS s FROM {_NULLS} GROUP BY g")
_add("null_join", "SELECT a.k AS k, b.v AS v FROM n a JOIN n b ON a.k = b.k", f"SELECT a.k, b.v FROM (SELECT * FROM {_NULLS}) AS a JOIN (SELECT * FROM {_NULLS}) AS b ON a.k = b.k")
_add("null_distinct", "SELECT DISTINCT g FROM n", f"SELECT DISTINCT g FROM {_NULLS}")


def _query(text: str, options: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        tables = catalog(spark, d)
        tables.waiting["n"] = lambda: tables.register("n", "k BIGINT, g STRING, v DOUBLE", NULL_ROWS)
        tables.waiting["times"] = lambda: tables.register("times", "e BIGINT, t TIMESTAMP", [(1, datetime(2024, 5, 6, 7, 8)), (2, None)])
        tables.waiting["texts"] = lambda: tables.register("texts", "t STRING", [("2024-05-06 07:08:00",), ("no time",), (None,)])
        return engine.sql(tables, text, **options)

    return run


def select_star(spark: SparkSession, d: str) -> DataFrame:
    out = engine.sql(catalog(spark, d), "SELECT * FROM nation n")
    return out.toDF(*[c.replace("n.", "", 1) for c in out.columns])


def join_nested_loop(spark: SparkSession, d: str) -> DataFrame:
    """The baseline join operator in the place of the planner's."""
    tables = catalog(spark, d)
    root = engine.compile_sql(tables, "SELECT n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey")
    join = root.children[0]
    root.children = (NestedLoopJoin(join.scope, join.children, join.left_key, join.right_key),)
    return engine._named(root, root.frame())


def _snapshots(spark: SparkSession, d: str) -> SnapshotTable:
    """orders in two appends, then overwritten and restored: versions 0 to 4."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    table = SnapshotTable.create(spark, working_path(spark), orders.schema)
    old = F.col("o_orderstatus") == "F"
    table.append(orders.where(old))
    table.append(orders.where(~old))
    table.overwrite(orders.where(F.col("o_custkey") < 100))
    table.restore(2)
    return table


def _at(version: int | None, text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        tables = Catalog(spark)
        tables.load_snapshot("orders", _snapshots(spark, d).path, version=version)
        return engine.sql(tables, text)

    return run


def snapshot_history(spark: SparkSession, d: str) -> DataFrame:
    commits = _snapshots(spark, d).history()
    return spark.createDataFrame([(c.version, c.operation, c.num_records) for c in commits], "version bigint, operation string, num_records bigint")


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A table written as CSV and read back with the types found in its cells."""
    path = working_path(spark)
    spark.read.parquet(f"{d}/part.parquet").write.option("header", True).option("escape", '"').csv(path)
    tables = Catalog(spark)
    tables.load_csv("part", path)
    return engine.sql(tables, "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")


_ANALYZED = "SELECT c.c_mktsegment AS s, COUNT(*) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'F' GROUP BY c.c_mktsegment"


def analyze_counts(spark: SparkSession, d: str) -> DataFrame:
    """Actual rows of every node of a profiled query."""

    def flat(plan) -> list[tuple[str, int]]:
        return [(plan.label, plan.actual_rows), *[row for c in plan.children for row in flat(c)]]

    return spark.createDataFrame(flat(engine.explain_analyze(catalog(spark, d), _ANALYZED, fetch=False).plan), "label string, actual_rows bigint")


def explain_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Rows the cost model expects of every node of the same query."""

    def flat(plan) -> list[tuple[str, float]]:
        return [(plan.label, round(plan.estimated_rows, 3)), *[row for c in plan.children for row in flat(c)]]

    return spark.createDataFrame(flat(engine.explain_analyze(catalog(spark, d), _ANALYZED, fetch=False).plan), "label string, estimated_rows double")


def statistics(spark: SparkSession, d: str) -> DataFrame:
    """What the cost model knows of a table: rows and distinct values."""
    tables = catalog(spark, d)
    known = table_stats(tables, tables.get("supplier"), {"s_nationkey", "s_suppkey"})
    return spark.createDataFrame([(c, known.row_count, n) for c, n in known.ndv.items()], "column_name string, row_count bigint, ndv bigint")


_SIMPLE = "SELECT o_orderkey, o_custkey FROM orders"
QUERIES = {name: _query(text, options) for name, (text, _, options) in TEXTS.items()} | {
    "select_star": select_star,
    "join_nested_loop": join_nested_loop,
    "snapshot_v1": _at(1, _SIMPLE),
    "snapshot_overwritten": _at(3, _SIMPLE),
    "snapshot_latest": _at(None, "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"),
    "snapshot_history": snapshot_history,
    "csv_round_trip": csv_round_trip,
    "analyze_counts": analyze_counts,
    "explain_estimates": explain_estimates,
    "statistics": statistics,
}
ORACLE = {name: oracle or text for name, (text, oracle, _) in TEXTS.items()} | {
    "select_star": "SELECT * FROM nation",
    "join_nested_loop": "SELECT n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey",
    "snapshot_v1": f"{_SIMPLE} WHERE o_orderstatus = 'F'",
    "snapshot_overwritten": f"{_SIMPLE} WHERE o_custkey < 100",
    "snapshot_latest": "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus",
    "snapshot_history": """SELECT CAST(version AS BIGINT) AS version, operation, CAST(num_records AS BIGINT) AS num_records FROM (VALUES (0, 'CREATE', 0), (1, 'APPEND', (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')), (2, 'APPEND', (SELECT count(*) FROM orders)),
  (3, 'OVERWRITE', (SELECT count(*) FROM orders WHERE o_custkey < 100)), (4, 'RESTORE', (SELECT count(*) FROM orders))) AS h(version, operation, num_records)""",
    "csv_round_trip": "SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
    "analyze_counts": """WITH j AS (SELECT c_mktsegment FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F')
SELECT 'Project s, n' AS label, count(DISTINCT c_mktsegment) AS actual_rows FROM j UNION ALL SELECT 'HashAggregate group_by=[c.c_mktsegment] aggs=[n]', count(DISTINCT c_mktsegment) FROM j
UNION ALL SELECT 'HashJoin c.c_custkey = o.o_custkey', count(*) FROM j UNION ALL SELECT 'Scan c', count(*) FROM customer
UNION ALL SELECT 'Filter o.o_orderstatus = ''F''', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'Scan o', count(*) FROM orders""",
    "explain_estimates": """WITH c AS (SELECT count(*) AS n, count(DISTINCT c_custkey) AS keys, count(DISTINCT c_mktsegment) AS segments FROM customer),
o AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS keys, count(*) / count(DISTINCT o_orderstatus) AS kept FROM orders), j AS (SELECT c.n * o.kept / greatest(c.keys, o.keys) AS rows, segments FROM c, o)
SELECT 'Project s, n' AS label, CAST(round(least(rows, segments), 3) AS DOUBLE) AS estimated_rows FROM j UNION ALL SELECT 'HashAggregate group_by=[c.c_mktsegment] aggs=[n]', round(least(rows, segments), 3) FROM j
UNION ALL SELECT 'HashJoin c.c_custkey = o.o_custkey', round(rows, 3) FROM j UNION ALL SELECT 'Scan c', n FROM c UNION ALL SELECT 'Filter o.o_orderstatus = ''F''', round(kept, 3) FROM o UNION ALL SELECT 'Scan o', n FROM o""",
    "statistics": "SELECT 's_nationkey' AS column_name, count(*) AS row_count, count(DISTINCT s_nationkey) AS ndv FROM supplier UNION ALL SELECT 's_suppkey', count(*), count(DISTINCT s_suppkey) FROM supplier",
}
