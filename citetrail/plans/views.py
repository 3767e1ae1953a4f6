"""Cleaned views of the analysis tables that several queries start from, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citetrail.operators.consolidate import last_per_pair
from citetrail.runtime import load, node_key


def live_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each node, unless it records a deletion; `scope` is the analysis, `node` the id as compared."""
    rows = load(spark, d, "source_nodes").withColumns({"scope": F.col("analysis_id"), "node": node_key("node_id")}).where("node <> '' and scope is not null")
    return last_per_pair(rows, ["scope", "node"], ["loaded_at", "id"]).where("deleted_at is null")


def live_edges(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each pair of ends within an analysis, without blank ends and self-links."""
    rows = load(spark, d, "source_edges").withColumns({"scope": F.col("analysis_id"), "source": node_key("source_node_id"), "target": node_key("target_node_id")})
    rows = rows.where("source <> '' and target <> '' and source <> target and scope is not null")
    return last_per_pair(rows, ["scope", "source", "target"], ["loaded_at", "id"])


def live_claims(spark: SparkSession, d: str) -> DataFrame:
    """Each claim id once, with its node."""
    rows = load(spark, d, "claims").withColumns({"scope": F.col("analysis_id"), "node": node_key("source_node_id")}).where("node <> '' and scope is not null")
    return last_per_pair(rows, ["id"], ["loaded_at", "scope", "node"])


def claim_triples(claims: DataFrame, *more: str) -> DataFrame:
    """scope, node, subject, predicate, object, and columns named: who says it, the text's second word, its last word."""
    words = F.split("claim_text", " ")
    return claims.where("attribution <> '' and claim_text like '% % %'").select(
        "scope", "node", F.col("attribution").alias("subject"), F.lower(words[1]).alias("predicate"), F.regexp_replace(F.element_at(words, -1), "[^A-Za-z]", "").alias("object"), *more
    ).where("object <> ''")


def extracted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What models would have extracted, in the columns the store takes: triples of the claims, and lists of entities.

    A triple's ord is (loaded_at, id) of its claim; the lists are the rows of entities, after all claims.
    """
    claims = live_claims(spark, d).select("scope", "node", "attribution", "claim_text", F.struct("loaded_at", "id").alias("ord"))
    ends = claim_triples(claims.withColumn("_o", F.col("ord")), "_o").withColumnRenamed("_o", "ord")
    triples = ends.select("scope", "node", "ord", F.lit(0).alias("pos"), "subject", F.lit("person").alias("subjectType"), "predicate", "object", F.lit("concept").alias("objectType"))
    rows = load(spark, d, "entities").where("analysis_id is not null")
    lists = rows.select(F.col("analysis_id").alias("scope"), F.struct(F.lit("9999-01-01 00:00:00").cast("timestamp").alias("loaded_at"), "id").alias("ord"), F.array(F.coalesce("canonical_name", F.lit(""))).alias("entities"))
    return triples, lists


#: CTEs of the same views.
SQL = """
live_nodes AS (
  SELECT * FROM (
    SELECT *, analysis_id AS scope, lower(trim(node_id)) AS node, row_number() OVER (PARTITION BY analysis_id, lower(trim(node_id)) ORDER BY loaded_at DESC, id DESC) AS r
    FROM source_nodes WHERE trim(node_id) <> '' AND analysis_id IS NOT NULL) WHERE r = 1 AND deleted_at IS NULL),
live_edges AS (
  SELECT * FROM (
    SELECT *, analysis_id AS scope, lower(trim(source_node_id)) AS source, lower(trim(target_node_id)) AS target,
      row_number() OVER (PARTITION BY analysis_id, lower(trim(source_node_id)), lower(trim(target_node_id)) ORDER BY loaded_at DESC, id DESC) AS r
    FROM source_edges WHERE trim(source_node_id) <> '' AND trim(target_node_id) <> '' AND lower(trim(source_node_id)) <> lower(trim(target_node_id)) AND analysis_id IS NOT NULL) WHERE r = 1),
live_claims AS (
  SELECT * FROM (
    SELECT *, analysis_id AS scope, lower(trim(source_node_id)) AS node, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, analysis_id DESC, lower(trim(source_node_id)) DESC) AS r
    FROM claims WHERE trim(source_node_id) <> '' AND analysis_id IS NOT NULL) WHERE r = 1),
triples AS (
  SELECT * FROM (
    SELECT scope, node, loaded_at, id, attribution AS subject, lower(string_split(claim_text, ' ')[2]) AS predicate, regexp_replace(string_split(claim_text, ' ')[-1], '[^A-Za-z]', '', 'g') AS object
    FROM live_claims WHERE attribution <> '' AND claim_text LIKE '% % %') WHERE object <> ''),
dictionary AS (
  SELECT scope, key, arg_min(name, o) AS name, arg_min(type, o) AS type FROM (
    SELECT scope, lower(subject) AS key, subject AS name, 'person' AS type, {'a': loaded_at, 'b': id, 'k': 0} AS o FROM triples WHERE subject <> ''
    UNION ALL SELECT scope, lower(object), object, 'concept', {'a': loaded_at, 'b': id, 'k': 1} FROM triples
    UNION ALL SELECT analysis_id, lower(canonical_name), canonical_name, 'concept', {'a': TIMESTAMPTZ '9999-01-01 00:00:00+00', 'b': id, 'k': 2} FROM entities WHERE canonical_name <> '' AND analysis_id IS NOT NULL)
  GROUP BY ALL)
"""
