"""Queries of the problems tagged llm, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citetrail.llm import body, lines, mixing, names, neighbours, packing, sentences
from citetrail.runtime import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(load(spark, d, "crawl_corpus"), min_clusters=1, min_days=1).select(F.col("page_id").alias("crawl_id"), "line_no")


def p1_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return lines.without_repeated_lines(load(spark, d, "crawl_corpus")).select(F.col("page_id").alias("crawl_id"), F.col("text").alias("markdown"), "n_removed")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return body.main_content(load(spark, d, "crawl_corpus")).select(F.col("page_id").alias("crawl_id"), F.explode("lines").alias("line_no"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(load(spark, d, "claims")).select(F.col("a").alias("claim_a"), F.col("b").alias("claim_b"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    e = names.name_pairs(names.link_names(load(spark, d, "entities"), "canonical_name", "entity_type")).withColumn("field_name", F.lit("canonical_name"))
    p = names.name_pairs(names.link_names(load(spark, d, "source_nodes"), "publisher")).withColumn("field_name", F.lit("publisher"))
    return e.unionByName(p).select("field_name", "name_a", "name_b")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(load(spark, d, "documents"), load(spark, d, "container_specs"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p8_packed(spark, d), load(spark, d, "container_specs"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(load(spark, d, "documents"), load(spark, d, "mix_targets"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(load(spark, d, "documents"), load(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(load(spark, d, "documents"))


_LINES_SQL = r"""
WITH page AS (
  SELECT crawl_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^(www|m)\.', '') AS site, string_split(markdown, chr(10)) AS ls
  FROM crawl_corpus WHERE markdown <> ''),
line AS (SELECT crawl_id, site, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM page),
k AS (
  SELECT crawl_id, site, line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(line), '^\s*[*+>#-]*\s*[0-9]{1,9}[.)](\s)', '\1'),
    '[\s\x{A0}*_]+', '', 'g'), '^[#>+-]+(.)', '\1'), '[0-9]+', '0', 'g') AS key FROM line),
hot AS (
  SELECT k.site, key FROM k JOIN (SELECT site, count(*) AS n FROM page GROUP BY site) s ON s.site = k.site WHERE key <> ''
  GROUP BY k.site, key, n HAVING count(DISTINCT crawl_id) >= 5 AND count(DISTINCT crawl_id) >= 0.2 * n)
"""

#: Documents are addresses with all their fetches and the copies of their texts; several of them, on several days.
_CLEANED_SQL = r"""
WITH page AS (
  SELECT crawl_id, markdown, (fetched_at AT TIME ZONE 'UTC')::DATE AS day, regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^(www|m)\.', '') AS site,
    regexp_replace(lower(regexp_replace(url, '^[A-Za-z]+://(?:[Ww][Ww][Ww]\.|[Mm]\.)?', '')), '/?([?#].*)?$', '') AS address FROM crawl_corpus WHERE markdown <> ''),
doc AS (SELECT *, min(address) OVER (PARTITION BY site, markdown) AS cluster, string_split(markdown, chr(10)) AS ls FROM page),
line AS (SELECT crawl_id, site, cluster, day, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM doc),
k AS (
  SELECT crawl_id, site, cluster, day, i, line, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(line), '^\s*[*+>#-]*\s*[0-9]{1,9}[.)](\s)', '\1'),
    '[\s\x{A0}*_]+', '', 'g'), '^[#>+-]+(.)', '\1'), '[0-9]+', '0', 'g') AS key FROM line),
hot AS (
  SELECT k.site, key FROM k JOIN (SELECT site, count(*) AS n FROM page GROUP BY site) s ON s.site = k.site WHERE key <> ''
  GROUP BY k.site, key, n HAVING count(DISTINCT crawl_id) >= 5 AND count(DISTINCT crawl_id) >= 0.2 * n AND count(DISTINCT cluster) >= 5 AND count(DISTINCT day) >= 2)
SELECT crawl_id, coalesce(string_agg(k.line, chr(10) ORDER BY i) FILTER (WHERE hot.key IS NULL), '') AS markdown, count(hot.key)::INT AS n_removed
FROM k LEFT JOIN hot ON hot.site = k.site AND hot.key = k.key GROUP BY crawl_id
"""

SQL = {"p1_found": _LINES_SQL + "SELECT crawl_id, line_no::INT AS line_no FROM k SEMI JOIN hot USING (site, key)", "p1_cleaned": _CLEANED_SQL}

QUERIES = {f.__name__: f for f in (p1_found, p1_cleaned, p2_found, p6_found, p7_found, p8_packed, p8_report, p9_mix, p9_report, p10_found)}
