"""How well two sources of an edge agree: shared entity pairs, then similar claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citetrail.functions.vector import dot, is_usable, unit


def _pair(s: str, o: str) -> list[Column]:
    a, b = F.lower(s), F.lower(o)
    return [F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")]


def matched_pairs(edges: DataFrame, triples: DataFrame) -> DataFrame:
    """edge columns, matched: how many different directed pairs of the edge's source its target has in either direction.

    edges(scope, edge_id, source, target), triples(scope, node, subject, object). The pair is joined as an unordered key,
    so no condition is left to a nested loop. Hot pairs are pre-aggregated per node.
    """
    directed = triples.select("scope", "node", F.lower("subject").alias("s"), F.lower("object").alias("o")).distinct()
    near = directed.groupBy("scope", "node", *_pair("s", "o")).agg(F.count(F.lit(1)).alias("n"))
    far = near.select("scope", F.col("node").alias("target"), "lo", "hi")
    hits = edges.join(near.withColumnRenamed("node", "source"), ["scope", "source"]).join(far, ["scope", "target", "lo", "hi"])
    return hits.groupBy("scope", "edge_id").agg(F.sum("n").alias("matched"))


def similar_claim_edges(edges: DataFrame, claims: DataFrame, least: float) -> DataFrame:
    """scope, edge_id: edges of which some claim of the source is at least so similar to some claim of the target."""
    # Lengths are taken once per claim, before the joins, and equal vectors of a node are one.
    ok = claims.where(is_usable(F.col("embedding"))).select("scope", "node", unit(F.col("embedding")).alias("u")).dropDuplicates()
    ends = edges.select("scope", "edge_id", "source", "target")
    a, b = ok.select("scope", F.col("node").alias("source"), F.col("u").alias("ua")), ok.select("scope", F.col("node").alias("target"), F.col("u").alias("ub"))
    return ends.join(a, ["scope", "source"]).join(b, ["scope", "target"]).where(dot(F.col("ua"), F.col("ub")) >= least).select("scope", "edge_id").distinct()


def corroboration(edges: DataFrame, claims: DataFrame, triples: DataFrame, least: float = 0.85) -> DataFrame:
    """edge columns, corroboration: unverified where a side has no claims; strong from two matched pairs, partial from one or from similar claims; else none.

    Similar claims are only looked for where no pair matched. Counts are of the source's pairs, so they depend on the direction.
    """
    has = claims.select("scope", "node").distinct()
    both = edges.join(has.withColumnRenamed("node", "source"), ["scope", "source"], "left_semi").join(has.withColumnRenamed("node", "target"), ["scope", "target"], "left_semi")
    pairs = matched_pairs(both.select("scope", "edge_id", "source", "target"), triples)
    known = both.select("scope", "edge_id", "source", "target").join(pairs, ["scope", "edge_id"], "left")
    close = similar_claim_edges(known.where("matched is null").drop("matched"), claims, least).withColumn("close", F.lit(True))
    level = F.when(F.col("both").isNull(), "unverified").when(F.col("matched") >= 2, "strong").when(F.col("matched") >= 1, "partial").when(F.col("close"), "partial").otherwise("none")
    return (
        edges.join(known.select("scope", "edge_id", "matched", F.lit(True).alias("both")), ["scope", "edge_id"], "left").join(close, ["scope", "edge_id"], "left").withColumn("corroboration", level).drop("both", "matched", "close")
    )


def shared_context(edges: DataFrame, triples: DataFrame, most: int = 10) -> DataFrame:
    """scope, edge_id, shared: up to `most` entity pairs both sides speak of, in order, with each side's predicates."""
    by_pair = triples.groupBy("scope", "node", *_pair("subject", "object")).agg(F.array_sort(F.collect_set("predicate")).alias("predicates"))
    a = by_pair.select("scope", F.col("node").alias("source"), "lo", "hi", F.col("predicates").alias("source_predicates"))
    b = by_pair.select("scope", F.col("node").alias("target"), "lo", "hi", F.col("predicates").alias("target_predicates"))
    hits = edges.join(a, ["scope", "source"]).join(b, ["scope", "target", "lo", "hi"])
    ordered = F.array_sort(F.collect_list(F.struct("lo", "hi", "source_predicates", "target_predicates")))
    return hits.groupBy("scope", "edge_id").agg(F.slice(ordered, 1, most).alias("shared"))


def entity_nodes(triples: DataFrame) -> DataFrame:
    """scope, entity, nodes: per analysis and entity (lower case) the nodes whose triples name it, in order; empty names are none."""
    ends = triples.select("scope", "node", F.explode(F.array(F.lower("subject"), F.lower("object"))).alias("entity")).where("entity <> ''").distinct()
    return ends.groupBy("scope", "entity").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
