"""Numbers of an analysis, from its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetrail.functions.dates import half_up


def edge_summary(scopes: DataFrame, edges: DataFrame) -> DataFrame:
    """scope, overall_fidelity, concern_count, strong_corroboration, weak_corroboration, n_edges per scope; zeros without edges.

    edges(scope, source_fidelity, corroboration, n_concerns). Partial corroboration is neither strong nor weak.
    """
    per = edges.groupBy("scope").agg(
        (half_up(F.avg(F.col("source_fidelity").cast("double")) * 100) / 100).alias("overall_fidelity"),
        F.sum("n_concerns").alias("concern_count"),
        F.count_if(F.col("corroboration") == "strong").alias("strong_corroboration"),
        F.count_if(F.col("corroboration").isin("none", "unverified")).alias("weak_corroboration"),
        F.count(F.lit(1)).alias("n_edges"),
    )
    return scopes.select("scope").distinct().join(per, "scope", "left").fillna(0)


def extraction_counts(claims: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """scope, n_claims, n_entities, n_triples: what was extracted per analysis; one pass, summed before rows move."""
    tables = [("n_claims", claims), ("n_entities", entities), ("n_triples", triples)]
    rows = None
    for name, df in tables:
        part = df.select("scope", *[F.lit(int(name == n)).cast("long").alias(n) for n, _ in tables])
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("scope").agg(*[F.sum(n).alias(n) for n, _ in tables])
