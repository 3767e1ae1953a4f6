"""Queries of the problems in the core: orphan references (p3), hierarchies (p4), instants (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citetrail.operators.hierarchy import descendants, hierarchy, paths_from_roots
from citetrail.operators.orphans import Child, orphan_counts, orphan_references
from citetrail.operators.timestamps import normalise_dates
from citetrail.runtime import load


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(load(spark, d, "source_nodes"), [Child(t, load(spark, d, t)) for t in ("source_edges", "claims")])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_id", "period").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(_orphans(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(load(spark, d, "source_edges")).select(F.col("scope").alias("analysis_id"), F.col("node").alias("node_id"), F.col("root").alias("root_node_id"), "depth")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    return paths_from_roots(load(spark, d, "source_edges")).select(F.col("scope").alias("analysis_id"), F.col("node").alias("node_id"), F.col("root").alias("root_node_id"), "depth", "path")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(load(spark, d, "source_edges")).select(F.col("scope").alias("analysis_id"), F.col("node").alias("node_id"), F.col("descendant").alias("descendant_id"), "depth")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    sites = load(spark, d, "sites")
    a = normalise_dates(load(spark, d, "analyses"), sites, "id", "article_date", "article_url")
    n = normalise_dates(load(spark, d, "source_nodes"), sites, "id", "date", "url")
    return a.withColumn("record_table", F.lit("analyses")).unionByName(n.withColumn("record_table", F.lit("source_nodes"))).where("utc_micros is not null").select("record_table", "record_id", "utc_micros")


_ORPHANS_SQL = """
WITH parent AS (
  SELECT analysis_id, lower(trim(node_id)) AS k, min(loaded_at) AS first_at, bool_or(deleted_at IS NOT NULL) FILTER (WHERE loaded_at = last_at) AS gone
  FROM (SELECT *, max(loaded_at) OVER (PARTITION BY analysis_id, lower(trim(node_id))) AS last_at FROM source_nodes)
  WHERE trim(node_id) <> '' GROUP BY ALL),
refs AS (
  SELECT 'source_edges' AS ref_table, id AS ref_id, analysis_id, lower(trim(source_node_id)) AS k, loaded_at FROM source_edges
  UNION ALL SELECT 'claims', id, analysis_id, lower(trim(source_node_id)), loaded_at FROM claims),
orphan AS (
  SELECT DISTINCT ref_table, ref_id, strftime(r.loaded_at AT TIME ZONE 'UTC', '%Y-%m') AS period,
    CASE WHEN gone THEN 'deleted' WHEN first_at IS NULL THEN 'missing' ELSE 'late' END AS reason
  FROM refs r LEFT JOIN parent p ON r.analysis_id = p.analysis_id AND r.k = p.k
  WHERE r.k <> '' AND (p.k IS NULL OR first_at > r.loaded_at OR gone))
"""
_LINKS_SQL = """
WITH RECURSIVE e AS (
  SELECT DISTINCT analysis_id, lower(trim(source_node_id)) AS child, lower(trim(target_node_id)) AS parent
  FROM source_edges WHERE trim(source_node_id) <> '' AND trim(target_node_id) <> ''),
"""

SQL = {
    "p3_found": _ORPHANS_SQL + "SELECT DISTINCT ref_table, ref_id, period FROM orphan",
    "p3_report": _ORPHANS_SQL + "SELECT ref_table, period, reason, count(DISTINCT ref_id) AS n_refs FROM orphan GROUP BY ALL",
    # Deeper than a shortest path can be means round a cycle: 200 levels bound the recursion on these tables.
    "p4_found": _LINKS_SQL
    + """
reach AS (
  SELECT DISTINCT analysis_id, parent AS node_id, parent AS root_node_id, 0 AS depth FROM e
  WHERE (analysis_id, parent) NOT IN (SELECT (analysis_id, child) FROM e)
  UNION SELECT r.analysis_id, e.child, r.root_node_id, r.depth + 1 FROM reach r JOIN e ON e.analysis_id = r.analysis_id AND e.parent = r.node_id WHERE r.depth < 200),
below AS (
  SELECT analysis_id, parent AS node, child FROM e
  UNION SELECT b.analysis_id, b.node, e.child FROM below b JOIN e ON e.analysis_id = b.analysis_id AND e.parent = b.child)
SELECT analysis_id, node_id, root_node_id, min(depth)::INT AS depth FROM reach GROUP BY ALL
UNION ALL SELECT DISTINCT analysis_id, node, '(cycle)', -1 FROM below WHERE node = child
""",
    "p4_paths": _LINKS_SQL
    + """
reach AS (
  SELECT DISTINCT analysis_id, parent AS node_id, parent AS root_node_id, 0 AS depth FROM e
  WHERE (analysis_id, parent) NOT IN (SELECT (analysis_id, child) FROM e)
  UNION SELECT r.analysis_id, e.child, r.root_node_id, r.depth + 1 FROM reach r JOIN e ON e.analysis_id = r.analysis_id AND e.parent = r.node_id WHERE r.depth < 200),
least AS (SELECT analysis_id, node_id, root_node_id, min(depth) AS depth FROM reach GROUP BY ALL),
via AS (
  SELECT a.analysis_id, a.node_id, a.root_node_id, a.depth, min(b.node_id) AS up FROM least a JOIN e ON e.analysis_id = a.analysis_id AND e.child = a.node_id
  JOIN least b ON b.analysis_id = a.analysis_id AND b.node_id = e.parent AND b.root_node_id = a.root_node_id AND b.depth = a.depth - 1 GROUP BY ALL),
path AS (
  SELECT analysis_id, node_id, root_node_id, depth, node_id AS path FROM least WHERE depth = 0
  UNION ALL SELECT v.analysis_id, v.node_id, v.root_node_id, v.depth, p.path || '/' || v.node_id FROM path p JOIN via v ON v.analysis_id = p.analysis_id AND v.up = p.node_id AND v.root_node_id = p.root_node_id AND v.depth = p.depth + 1)
SELECT analysis_id, node_id, root_node_id, depth::INT AS depth, path FROM path
""",
    "p4_descendants": _LINKS_SQL
    + """
below AS (
  SELECT analysis_id, parent AS node_id, child AS descendant_id, 1 AS depth FROM e
  UNION SELECT b.analysis_id, b.node_id, e.child, b.depth + 1 FROM below b JOIN e ON e.analysis_id = b.analysis_id AND e.parent = b.descendant_id WHERE b.depth < 200)
SELECT analysis_id, node_id, descendant_id, min(depth)::INT AS depth FROM below GROUP BY ALL
""",
}

QUERIES = {f.__name__: f for f in (p3_found, p3_report, p4_found, p4_paths, p4_descendants, p5_found)}
