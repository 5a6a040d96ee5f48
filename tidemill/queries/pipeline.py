"""Data-loading queries of the core and their SQL: bad records, broken references, load profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import column_profile as cp
from tidemill.operators import references as rf
from tidemill.runtime import table
from tidemill.sources.delimited import IntCell, TextCell, read_records, rejected, valid_rows

RECORD_CELLS = {
    "id": IntCell(nullable=False),
    "customer_id": IntCell(),
    "order_id": IntCell(),
    "year": IntCell(least=2000, most=2035),
    "revenue": IntCell(),
    "region": TextCell(),
    "sku": TextCell(),
}


def _records(spark: SparkSession, d: str) -> DataFrame:
    return read_records(table(spark, d, "csv_records"), table(spark, d, "csv_files"), RECORD_CELLS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected(_records(spark, d)).where(F.col("reason") != "no_file").select("record_id", "reason")


def p1_orders(spark: SparkSession, d: str) -> DataFrame:
    return valid_rows(_records(spark, d), "orders", ["id", "customer_id", "region", "year"])


def p1_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return valid_rows(_records(spark, d), "lineitem", ["order_id", "sku", "revenue"])


def _broken(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "shop_lineitem")
    changes = table(spark, d, "order_changes")
    orders = table(spark, d, "shop_orders")
    refs = lines.select(F.lit("shop_lineitem").alias("src_table"), F.col("line_id").alias("row_id"), F.col("order_id").alias("ref"), F.col("loaded_at").alias("at"), F.lit(True).alias("check_removed")).unionByName(
        changes.select(F.lit("order_changes").alias("src_table"), F.col("change_id").alias("row_id"), F.col("order_id").alias("ref"), F.col("changed_at").alias("at"), F.lit(False).alias("check_removed"))
    )
    return rf.broken_references(
        refs,
        orders.select(F.col("id").alias("key"), F.col("loaded_at").alias("at")),
        changes.select(F.col("change_id").alias("seq"), F.col("order_id").alias("key"), "op", F.col("changed_at").alias("at")),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).select("src_table", "row_id", "reason")


def p2_by_month(spark: SparkSession, d: str) -> DataFrame:
    return rf.broken_by_month(_broken(spark, d))


def p2_composite(spark: SparkSession, d: str) -> DataFrame:
    """Recorded statistics as references to the orders they describe, by load, region and year, of which the last two may be NULL, under each of the match semantics."""
    keys = [(c, c) for c in ("load_no", "region", "year")]
    records, orders = table(spark, d, "table_stats").select("stat_id", *[c for c, _ in keys]), table(spark, d, "shop_orders").select(*[c for c, _ in keys])
    parts = [rf.match_references(records, orders, keys, {}, match).where("orphan").select(F.lit(match).alias("semantics"), "stat_id", "null_mask") for match in ("simple", "partial", "full")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _profile(spark: SparkSession, d: str, limited: bool = True) -> cp.Profile:
    tables = {name: table(spark, d, name) for name in ("shop_orders", "shop_lineitem")}
    return cp.profile_loads(tables, table(spark, d, "column_limits"), load="load_no", limited=limited)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return cp.broken_limits(_profile(spark, d), table(spark, d, "table_stats"))


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column of every load but the load number itself."""
    return cp.describe(_profile(spark, d, limited=False))


def p5_rare_masks(spark: SparkSession, d: str) -> DataFrame:
    return cp.rare_masks(_profile(spark, d, limited=False))


QUERIES = {f.__name__: f for f in (p1_found, p1_orders, p1_lineitem, p2_found, p2_by_month, p2_composite, p5_found, p5_profile, p5_rare_masks)}

_CELL = """'("(?:[^"]|"")*"|[^"' || q || ']*)'"""
_RECORDS = f"""
WITH line AS (
  SELECT record_id, target_name, header_line, cell_mark AS m, CASE WHEN cell_mark = chr(9) THEN chr(92) || 't' ELSE cell_mark END AS q,
    CASE WHEN raw_line LIKE '%' || chr(13) THEN left(raw_line, length(raw_line) - 1) ELSE raw_line END AS l
  FROM csv_records JOIN csv_files USING (file_id)
), kept AS (SELECT *, regexp_full_match(l, {_CELL} || '(?:' || q || {_CELL} || ')*', 's') AS sound, string_split(header_line, m) AS head FROM line WHERE trim(l, ' ') <> ''),
cut AS (SELECT *, CASE WHEN sound THEN regexp_extract_all(m || l, q || {_CELL}, 1, 's') END AS c FROM kept),
cells AS (SELECT *, list_transform(c, lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS v, sound AND len(c) = len(head) AS fits FROM cut),
named AS (SELECT *, {", ".join(f"CASE WHEN fits AND list_position(head, '{n}') > 0 THEN nullif(v[list_position(head, '{n}')], '') END AS s_{n}" for n in RECORD_CELLS)} FROM cells),
typed AS (SELECT *, {", ".join(f"CASE WHEN regexp_full_match(trim(s_{n}, ' '), '[+-]?[0-9]+(?:_[0-9]+)*') THEN TRY_CAST(TRY_CAST(replace(trim(s_{n}, ' '), '_', '') AS HUGEINT) AS BIGINT) END AS i_{n}" for n, k in RECORD_CELLS.items() if isinstance(k, IntCell))} FROM named),
judged AS (SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN NOT fits THEN 'column_count'
    WHEN {" OR ".join(f"(s_{n} IS NOT NULL AND i_{n} IS NULL)" for n, k in RECORD_CELLS.items() if isinstance(k, IntCell))} OR i_year NOT BETWEEN 2000 AND 2035 OR (list_position(head, 'id') > 0 AND i_id IS NULL) THEN 'bad_value' END AS reason FROM typed)
"""
_BROKEN = """
WITH first AS (SELECT id, min(loaded_at) AS seen FROM shop_orders GROUP BY id),
refs AS (SELECT 'shop_lineitem' AS src_table, line_id AS row_id, order_id, loaded_at AS t FROM shop_lineitem UNION ALL SELECT 'order_changes', change_id, order_id, changed_at FROM order_changes),
hist AS (SELECT order_id, changed_at, arg_max(op, change_id) AS op FROM order_changes WHERE op IN ('remove', 'restore') GROUP BY ALL),
lines AS (SELECT l.line_id, h.op FROM shop_lineitem l ASOF JOIN hist h ON l.order_id = h.order_id AND l.loaded_at >= h.changed_at),
broken AS (SELECT src_table, row_id, r.t, CASE WHEN f.id IS NULL THEN 'missing' WHEN f.seen > r.t THEN 'late' WHEN src_table = 'shop_lineitem' AND lines.op = 'remove' THEN 'deleted' END AS reason
  FROM refs r LEFT JOIN first f ON f.id = r.order_id LEFT JOIN lines ON src_table = 'shop_lineitem' AND lines.line_id = r.row_id WHERE r.order_id IS NOT NULL)
"""
_COLUMNS = {"shop_orders": ("customer_id", "region", "year"), "shop_lineitem": ("order_id", "sku", "revenue")}
_LOADS = (
    "WITH v AS MATERIALIZED ("
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, load_no, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {t} GROUP BY load_no, {c}" for t, cs in _COLUMNS.items() for c in cs)
    + """), prof AS (SELECT table_name, column_name, load_no, CAST(sum(n) AS BIGINT) AS row_count, CAST(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS null_count, count(value) AS ndv FROM v GROUP BY ALL),
shares AS (SELECT v.*, n / (row_count - null_count) AS p FROM v JOIN prof USING (table_name, column_name, load_no) WHERE value IS NOT NULL),
moved AS (SELECT table_name, column_name, load_no, value, sum(p) AS d FROM (SELECT table_name, column_name, load_no, value, p FROM shares UNION ALL SELECT table_name, column_name, load_no + 1, value, -p FROM shares) GROUP BY ALL),
shift AS (SELECT m.table_name, m.column_name, m.load_no, sum(abs(d)) / 2 AS shift FROM moved m JOIN prof a USING (table_name, column_name, load_no) JOIN prof b ON b.table_name = m.table_name AND b.column_name = m.column_name AND b.load_no = m.load_no - 1
  WHERE a.ndv > 0 AND b.ndv > 0 GROUP BY ALL)
"""
)
_ALL = {"shop_orders": ("row_id", "id", "customer_id", "region", "year", "ordered_at", "loaded_at"), "shop_lineitem": ("line_id", "order_id", "sku", "revenue", "loaded_at")}
_ALL_MASKS = (
    "WITH v AS MATERIALIZED ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, load_no, {f"CAST({c} AT TIME ZONE 'UTC' AS VARCHAR)" if c.endswith('_at') else f'CAST({c} AS VARCHAR)'} AS value, {'NULL' if c in ('region', 'sku') else f'epoch_us({c})' if c.endswith('_at') else c} AS num, count(*) AS n FROM {t} GROUP BY load_no, {c}"
        for t, cs in _ALL.items()
        for c in cs
    )
    + r"""), prof AS (SELECT table_name, column_name, load_no, CAST(sum(n) AS BIGINT) AS row_count, CAST(coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS BIGINT) AS null_count, count(value) AS ndv, min(num) AS lo, max(num) AS hi FROM v GROUP BY ALL),
masks AS (SELECT table_name, column_name, load_no, mask, CAST(sum(n) AS BIGINT) AS n, min(value) AS example FROM (SELECT *,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(value, '\p{Lu}+', 'A', 'g'), '\p{Ll}+', 'a', 'g'), '\p{Nd}+', '9', 'g'), '\s+', '_', 'g') AS mask FROM v WHERE value IS NOT NULL) GROUP BY ALL),
pairs AS (SELECT a.table_name, a.column_name, a.load_no, a.row_count - a.null_count AS size, b.row_count - b.null_count AS size_was FROM prof a JOIN prof b ON b.table_name = a.table_name AND b.column_name = a.column_name AND b.load_no = a.load_no - 1 WHERE a.ndv > 0 AND b.ndv > 0)
"""
)


def _moved(what: str, counts: str) -> str:
    """SQL of a shift per load: 1 less what a load and the one before have in common."""
    return f"""(SELECT p.table_name, p.column_name, p.load_no, 1 - coalesce(common, 0) AS shift FROM pairs p LEFT JOIN (SELECT p.table_name, p.column_name, p.load_no, sum(least(a.n / p.size, b.n / p.size_was)) AS common
  FROM pairs p JOIN {counts} a USING (table_name, column_name, load_no) JOIN {counts} b ON b.table_name = a.table_name AND b.column_name = a.column_name AND b.load_no = a.load_no - 1 AND b.{what} = a.{what} GROUP BY ALL) c USING (table_name, column_name, load_no))"""


ORACLE = {
    "p1_found": _RECORDS + "SELECT record_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_orders": _RECORDS + "SELECT record_id, i_id AS id, i_customer_id AS customer_id, s_region AS region, i_year AS year FROM judged WHERE reason IS NULL AND target_name = 'orders'",
    "p1_lineitem": _RECORDS + "SELECT record_id, i_order_id AS order_id, s_sku AS sku, i_revenue AS revenue FROM judged WHERE reason IS NULL AND target_name = 'lineitem'",
    "p2_found": _BROKEN + "SELECT src_table, row_id, reason FROM broken WHERE reason IS NOT NULL",
    "p2_by_month": _BROKEN + "SELECT src_table, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS month, reason, count(*) AS n FROM broken WHERE reason IS NOT NULL GROUP BY ALL",
    "p2_composite": """WITH o AS (SELECT DISTINCT load_no, region, year FROM shop_orders), r AS (SELECT stat_id, load_no, region, year, (load_no IS NULL)::INT::VARCHAR || (region IS NULL)::INT::VARCHAR || (year IS NULL)::INT::VARCHAR AS null_mask FROM table_stats),
m AS (SELECT r.*, EXISTS (SELECT 1 FROM o WHERE o.load_no = r.load_no AND (r.region IS NULL OR o.region = r.region) AND (r.year IS NULL OR o.year = r.year)) AS met FROM r)
SELECT 'simple' AS semantics, stat_id, null_mask FROM m WHERE null_mask = '000' AND NOT met UNION ALL SELECT 'partial', stat_id, null_mask FROM m WHERE null_mask <> '111' AND NOT met
UNION ALL SELECT 'full', stat_id, null_mask FROM m WHERE null_mask <> '111' AND (null_mask <> '000' OR NOT met)""",
    "p5_found": _LOADS
    + """, m AS (SELECT v.*, l.* EXCLUDE (table_name, column_name), TRY_CAST(value AS BIGINT) AS num FROM v JOIN column_limits l USING (table_name, column_name)),
agg AS (SELECT table_name, column_name, load_no, sum(n) AS rows, coalesce(sum(n) FILTER (WHERE value IS NULL), 0) AS nulls, coalesce(sum(n) FILTER (WHERE num < min_value OR num > max_value), 0) AS out, coalesce(sum(n) FILTER (WHERE NOT regexp_full_match(value, value_pattern)), 0) AS off,
  count(value) AS ndv, any_value(max_null_rate) AS max_null_rate, any_value(max_bad_rate) AS max_bad_rate, any_value(min_distinct) AS min_distinct, any_value(max_shift) AS max_shift, any_value(value_pattern) AS value_pattern FROM m GROUP BY ALL)
SELECT table_name, load_no, column_name, 'null_rate' AS check_name FROM agg WHERE nulls / rows > max_null_rate
UNION ALL SELECT table_name, load_no, column_name, 'value_range' FROM agg WHERE rows > nulls AND out / (rows - nulls) > max_bad_rate
UNION ALL SELECT table_name, load_no, column_name, 'pattern' FROM agg WHERE rows > nulls AND value_pattern IS NOT NULL AND off / (rows - nulls) > max_bad_rate
UNION ALL SELECT table_name, load_no, column_name, 'few_distinct' FROM agg WHERE ndv < min_distinct
UNION ALL SELECT table_name, load_no, column_name, 'shift' FROM shift JOIN column_limits USING (table_name, column_name) WHERE shift > max_shift
UNION ALL SELECT DISTINCT s.table_name, s.load_no, s.column_name, 'row_count' FROM table_stats s LEFT JOIN (SELECT table_name, load_no, max(row_count) AS n FROM prof GROUP BY ALL) c USING (table_name, load_no)
  WHERE s.region IS NULL AND s.year IS NULL AND s.sku IS NULL AND s.row_count <> coalesce(c.n, 0) AND s.table_name IN ('shop_orders', 'shop_lineitem')""",
    "p5_profile": _ALL_MASKS
    + f"""SELECT p.table_name, p.load_no, p.column_name, row_count, null_count, ndv, lo AS min_value, hi AS max_value, round(s.shift, 9) AS shift, round(x.shift, 9) AS mask_shift FROM prof p
LEFT JOIN {_moved("value", "v")} s USING (table_name, column_name, load_no) LEFT JOIN {_moved("mask", "masks")} x USING (table_name, column_name, load_no)""",
    "p5_rare_masks": _ALL_MASKS
    + """, overall AS (SELECT table_name, column_name, mask, k / sum(k) OVER (PARTITION BY table_name, column_name) AS share FROM (SELECT table_name, column_name, mask, sum(n) AS k FROM masks GROUP BY ALL))
SELECT m.table_name, m.load_no, m.column_name, m.mask, m.n, m.example, round(share, 9) AS share FROM masks m JOIN overall USING (table_name, column_name, mask) WHERE share < 0.01""",
}
