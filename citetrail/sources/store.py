"""Analyses at rest: one folder of Parquet tables per write, made visible by a manifest."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("analyses", "nodes", "phantom_claims", "edges", "concerns", "entities", "claims", "triples")


def entity_table(triples: DataFrame, claims: DataFrame) -> DataFrame:
    """scope, key, name, type: entities of a scope by lower-case name, spelt and typed as first met: by claim, its triples before its own list, where the type is concept."""
    t = triples.select("scope", "ord", F.explode(F.array(F.struct(F.lit(0).alias("k"), "pos", F.lit(0).alias("side"), F.col("subject").alias("name"), F.col("subjectType").alias("type")), F.struct(F.lit(0).alias("k"), "pos", F.lit(1).alias("side"), F.col("object").alias("name"), F.col("objectType").alias("type")))).alias("e"))
    c = claims.select("scope", "ord", F.posexplode("entities").alias("p", "name")).select("scope", "ord", F.struct(F.lit(1).alias("k"), F.col("p").alias("pos"), F.lit(0).alias("side"), "name", F.lit("concept").alias("type")).alias("e"))
    rows = t.unionByName(c).where("e.name <> ''")
    first = rows.groupBy("scope", F.lower("e.name").alias("key")).agg(F.min_by("e", F.struct("ord", "e.k", "e.pos", "e.side")).alias("e"))
    return first.select("scope", "key", F.col("e.name").alias("name"), F.col("e.type").alias("type"))


def resolve_triples(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples with the keys of both ends; those with an end that is no entity are left out."""
    e = entities.select("scope", "key")
    out = triples.withColumns({"subject_key": F.lower("subject"), "object_key": F.lower("object")})
    return out.join(e.withColumnRenamed("key", "subject_key"), ["scope", "subject_key"]).join(e.withColumnRenamed("key", "object_key"), ["scope", "object_key"])


def save(tables: dict[str, DataFrame], path: str) -> str:
    """Write all tables under a new version, then its manifest; readers see all of it or nothing."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/data/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version, ",".join(tables))], "version string, tables string").coalesce(1).write.mode("append").json(f"{path}/manifest")
    return version


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """All published rows of a table."""
    versions = [r.version for r in spark.read.schema("version string, tables string").json(f"{path}/manifest").where(F.array_contains(F.split("tables", ","), table)).collect()]
    return spark.read.parquet(*[f"{path}/data/{v}/{table}" for v in sorted(versions)])


def rows_of(articles: DataFrame, out: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of TABLES from articles(scope, url) and what `pipeline.run` gives for them; lists become rows with their place.

    Triples keep only ends that are entities, and name them by key.
    """
    root = out["nodes"].where("node = 'article'").select("scope", F.col("title").alias("article_title"), F.col("publisher").alias("article_publisher"), F.col("date").alias("article_date"), F.col("snippet").alias("article_snippet"))
    told = out["summary"].select(
        "scope", F.col("text").alias("summary_text"), F.col("overall_fidelity").alias("summary_fidelity"), F.col("concern_count").alias("summary_concern_count"), F.col("strong_corroboration").alias("summary_strong_corroboration"),
        F.col("weak_corroboration").alias("summary_weak_corroboration"), F.to_json("unverified_claims").alias("summary_unverified_claims"),
    )
    analyses = articles.select("scope", F.col("url").alias("article_url")).join(root, "scope").join(told, "scope", "left").withColumn("created_at", F.current_timestamp())
    listed = lambda df, keys, column, name: df.select(*keys, F.posexplode(column).alias("sort_order", name))
    entities = entity_table(out["triples"], out["claims"])
    return {
        "analyses": analyses,
        "nodes": out["nodes"].select("scope", "node", "title", "url", "publisher", "date", "source_type", "snippet", "phantom", "phantom_key", F.col("node_ord").alias("ord")),
        "phantom_claims": listed(out["nodes"].where("phantom"), ["scope", "node"], "attributed_claims", "claim"),
        "edges": out["edges"].select("scope", "edge_id", "source", "target", "source_fidelity", "editorialization", F.col("source_type").alias("metric_source_type"), "corroboration", F.col("seq").alias("ord")),
        "concerns": listed(out["edges"], ["scope", "edge_id"], "concerns", "concern"),
        "entities": entities,
        "claims": out["claims"].select("scope", "node", F.col("claim").alias("claim_text"), "attribution", "embedding", "ord"),
        "triples": resolve_triples(out["triples"], entities).select("scope", "node", "ord", "pos", "subject_key", "predicate", "object_key", "context"),
    }


def _numbers(row: str) -> Column:
    return F.struct(
        F.col(f"{row}_text").alias("text"), F.coalesce(f"{row}_fidelity", F.lit(0.0)).cast("double").alias("overall_fidelity"), F.coalesce(f"{row}_concern_count", F.lit(0)).cast("long").alias("concern_count"),
        F.coalesce(f"{row}_strong_corroboration", F.lit(0)).cast("long").alias("strong_corroboration"), F.coalesce(f"{row}_weak_corroboration", F.lit(0)).cast("long").alias("weak_corroboration"),
        F.coalesce(F.from_json(f"{row}_unverified_claims", "array<string>"), F.array().cast("array<string>")).alias("unverified_claims"),
    )


def reassemble(tables: dict[str, DataFrame]) -> DataFrame:
    """scope, article_url, article, summary, nodes, edges, claims: each analysis as one row, from the tables of TABLES (entities and triples are not needed).

    summary is null without a text, and its numbers are 0 where they are null. A node's phantom_key and attributed_claims
    are null unless it is a phantom. Concerns and phantom claims stand in their order, nodes, edges and claims in that of
    `ord`. claims are lists by node, with no entities. Tables that are not there are empty.
    """
    none = F.array().cast("array<string>")

    def in_order(name: str, keys: list[str], value: str, out: str) -> DataFrame | None:
        if name not in tables:
            return None
        return tables[name].groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", value))), lambda x: x[value]).alias(out))

    def with_list(df: DataFrame, lists: DataFrame | None, keys: list[str], out: str) -> DataFrame:
        df = df.withColumn(out, none) if lists is None else df.join(lists, keys, "left")
        return df.withColumn(out, F.coalesce(out, none))

    nodes = with_list(tables["nodes"], in_order("phantom_claims", ["scope", "node"], "claim", "_said"), ["scope", "node"], "_said")
    ghost = F.coalesce("phantom", F.lit(False))
    node = F.struct(
        F.col("node").alias("id"), "title", "url", "publisher", "date", "source_type", "snippet", ghost.alias("phantom"), F.when(ghost, F.col("phantom_key")).alias("phantom_key"), F.when(ghost, F.col("_said")).alias("attributed_claims")
    )
    edges = with_list(tables["edges"], in_order("concerns", ["scope", "edge_id"], "concern", "_concerns"), ["scope", "edge_id"], "_concerns")
    metrics = F.struct("source_fidelity", "editorialization", F.col("metric_source_type").alias("source_type"), "corroboration")
    edge = F.struct(F.col("edge_id").alias("id"), "source", "target", metrics.alias("metrics"), F.col("_concerns").alias("concerns"))

    def gathered(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
        rows = df.select(*keys, F.struct(*[F.col(c) for c in order]).alias("_o"), value.alias("_v"))
        return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda x: x["_v"]).alias(out))

    said = gathered(tables["claims"], ["scope", "node"], ["ord"], F.struct(F.col("claim_text").alias("claim"), F.array().cast("array<string>").alias("entities"), "attribution"), "c")
    said = said.groupBy("scope").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "c")))).alias("claims"))
    head = tables["analyses"].select(
        "scope", "article_url", F.struct(*[F.col(f"article_{c}").alias(c) for c in ("title", "url", "publisher", "date", "snippet")]).alias("article"), F.when(F.coalesce("summary_text", F.lit("")) != "", _numbers("summary")).alias("summary")
    )
    out = head.join(gathered(nodes, ["scope"], ["ord"], node, "nodes"), "scope", "left").join(gathered(edges, ["scope"], ["ord"], edge, "edges"), "scope", "left")
    return out.join(said, "scope", "left")


def analysis_by_url(spark: SparkSession, path: str, url: str) -> DataFrame:
    """The stored analysis of an address, put together; no row if there is none. The address is pushed down to the scan."""
    head = read(spark, path, "analyses").where(F.col("article_url") == url)
    rest = {t: read(spark, path, t).join(head.select("scope"), "scope", "left_semi") for t in ("nodes", "phantom_claims", "edges", "concerns", "claims")}
    return reassemble({"analyses": head, **rest})


def seed(spark: SparkSession, path: str, articles: DataFrame, out: dict[str, DataFrame]) -> str:
    """Store an analysis made elsewhere, such as a fixture, unless one of its addresses is stored already; the version written, or that there is."""
    tables = rows_of(articles, out)
    try:
        there = read(spark, path, "analyses").join(articles.select(F.col("url").alias("article_url")), "article_url", "left_semi")
        if not there.isEmpty():
            return ""
    except AnalysisException:  # nothing stored yet
        pass
    return save(tables, path)
