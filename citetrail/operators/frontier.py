"""Candidates of a level, and the budgets on what is followed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citetrail.functions.urls import is_analyzable_url, normalize_url


def top_candidates(candidates: DataFrame, k: int, scope: str = "scope", ordinal: str = "ord") -> DataFrame:
    """The k candidates of each scope by priority, of equal ones the earlier."""
    w = Window.partitionBy(scope).orderBy(F.desc("priority"), ordinal)
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def gather_candidates(links: DataFrame, visited: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New candidates, and all parents of addresses.

    links(scope, url, parent, priority, ord), visited(scope, norm_url), parents(scope, norm_url, parent). An address not
    met before becomes one candidate by its first link, with all who link it as parents; one met before takes further
    parents only if it has any (the root has none).
    """
    ok = links.where(is_analyzable_url(F.col("url"))).withColumn("norm_url", normalize_url(F.col("url")))
    fresh = ok.join(visited.select("scope", "norm_url").distinct(), ["scope", "norm_url"], "left_anti")
    w = Window.partitionBy("scope", "norm_url").orderBy("ord")
    new = fresh.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("scope", "norm_url", "url", "priority", "ord")
    again = ok.join(parents.select("scope", "norm_url").distinct(), ["scope", "norm_url"], "left_semi")
    more = fresh.select("scope", "norm_url", "parent").unionByName(again.select("scope", "norm_url", "parent"))
    return new, parents.select("scope", "norm_url", "parent").unionByName(more).distinct()


def phantom_edges(mentions: DataFrame, per_parent: int = 5, per_scope: int = 15) -> DataFrame:
    """Mentions that become edges: the first of each parent, without blank keys and repeats of a parent's key, up to the budget of the scope.

    mentions(scope, parent, parent_ord, pos, key, ...). A blank key uses up a place of its parent.
    """
    w = Window.partitionBy("scope", "parent").orderBy("pos")
    first = mentions.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= per_parent) & (F.col("key") != ""))
    once = first.withColumn("_r", F.row_number().over(Window.partitionBy("scope", "parent", "key").orderBy("pos"))).where("_r = 1")
    total = Window.partitionBy("scope").orderBy("parent_ord", "pos")
    return once.withColumn("_r", F.row_number().over(total)).where(F.col("_r") <= per_scope).drop("_r")


def match_candidates(phantoms: DataFrame, reals: DataFrame, most: int = 50) -> DataFrame:
    """scope, phantom, real, place: a scope's phantoms with its real nodes, phantoms first, cut to the first `most`.

    Only as many phantoms and reals as the cut can reach are paired, so the join's size is bounded per scope.
    """
    p = phantoms.withColumn("pr", F.row_number().over(Window.partitionBy("scope").orderBy("ord"))).where(F.col("pr") <= most).select("scope", F.col("id").alias("phantom"), "pr")
    r = reals.withColumn("rr", F.row_number().over(Window.partitionBy("scope").orderBy("ord"))).where(F.col("rr") <= most).select("scope", F.col("id").alias("real"), "rr")
    n = reals.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    place = (F.col("pr") - 1) * F.col("n") + F.col("rr")
    return p.join(n, "scope").where((F.col("pr") - 1) * F.col("n") < most).join(r, "scope").withColumn("place", place).where(F.col("place") <= most).select("scope", "phantom", "real", "place")
