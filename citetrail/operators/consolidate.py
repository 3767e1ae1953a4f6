"""Merging nodes that are the same, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citetrail.runtime import Growing, drop, materialise


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """a, b, jaccard (a.ord < b.ord, equal scopes): every pair of different sets with at least this Jaccard similarity.

    sets(scope, id, ord, items array<string>). Exact by prefix filtering: members are ordered from rare to common, and
    two similar sets must share one of the first n - ceil(least * n) + 1 of either; sizes must fit too. Empty sets match nothing.
    """
    items = sets.where(F.size("items") > 0).select("scope", "id", "ord", F.size("items").alias("n"), F.explode(F.transform("items", lambda x: F.xxhash64(x))).alias("x")).distinct()
    common = items.groupBy("scope", "x").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # A member that only one set has cannot be shared; it still counts in the size.
    bags = items.join(common, ["scope", "x"]).groupBy("scope", "id", "ord", "n").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("xs"))
    bags = materialise(bags.select("scope", "id", "ord", "n", F.transform("xs", lambda s: s["x"]).alias("xs")))
    # The rare members left out stand first in the order, so they use up the prefix.
    prefix = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1 - (F.col("n") - F.size("xs"))
    heads = bags.where(prefix > 0).select("scope", "id", "ord", "n", F.explode(F.slice("xs", 1, prefix.cast("int"))).alias("x"))
    a, b = heads.select("scope", "x", F.col("id").alias("a"), F.col("ord").alias("ao"), F.col("n").alias("an")), heads.select("scope", "x", F.col("id").alias("b"), F.col("ord").alias("bo"), F.col("n").alias("bn"))
    pairs = a.join(b, ["scope", "x"]).where((F.col("ao") < F.col("bo")) & (F.least("an", "bn") >= F.greatest("an", "bn") * least - 1e-9)).select("scope", "a", "b").distinct()
    full = bags.select("scope", F.col("id").alias("a"), F.col("n").alias("an"), F.col("xs").alias("ax"))
    other = bags.select("scope", F.col("id").alias("b"), F.col("n").alias("bn"), F.col("xs").alias("bx"))
    both = F.size(F.array_intersect("ax", "bx"))
    scored = pairs.join(full, ["scope", "a"]).join(other, ["scope", "b"]).withColumn("jaccard", both / (F.col("an") + F.col("bn") - both))
    return scored.where(F.col("jaccard") >= least - 1e-12).select("scope", "a", "b", "jaccard")


def leaders(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """scope, id, leader: greedy clustering in the order of `ord`, in parallel rounds.

    A node is a leader when no leader before it is similar; every other goes to the first leader similar to it, and
    draws nothing to itself. nodes(scope, id, ord) with unique ids, pairs(scope, a, b). Nodes without pairs lead themselves.
    Each round lets the nodes without an open neighbour before them lead, and takes away what they draw; only the links
    between open nodes are written again, and only who is drawn is kept.
    """
    order = nodes.select("scope", "id", "ord")
    links = pairs.join(order.select("scope", F.col("id").alias("a"), F.col("ord").alias("ao")), ["scope", "a"]).join(order.select("scope", F.col("id").alias("b"), F.col("ord").alias("bo")), ["scope", "b"])
    up = F.col("ao") < F.col("bo")
    links = materialise(links.select("scope", F.when(up, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("hi"), F.least("ao", "bo").alias("ord")).distinct())
    drawn = Growing(links.select("scope", F.col("hi").alias("id")).where("1 = 0"))
    live = links
    while not live.isEmpty():
        first = live.join(live.select("scope", F.col("hi").alias("lo")).distinct(), ["scope", "lo"], "left_anti")
        new = drawn.add(first.select("scope", F.col("hi").alias("id")).distinct())
        # What leads has only links to what it draws, so these go with them.
        left = materialise(live.join(new.withColumnRenamed("id", "lo"), ["scope", "lo"], "left_anti").join(new.withColumnRenamed("id", "hi"), ["scope", "hi"], "left_anti"))
        if live is not links:
            drop(live)
        live = left
    led = links.join(drawn.read().withColumnRenamed("id", "lo"), ["scope", "lo"], "left_anti").groupBy("scope", F.col("hi").alias("id")).agg(F.min_by("lo", "ord").alias("leader"))
    return nodes.select("scope", "id").join(led, ["scope", "id"], "left").select("scope", "id", F.coalesce("leader", "id").alias("leader"))


def redirect_edges(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Edges with merged ends replaced, without those that then join a node with itself; ids stay. remap(scope, id, leader)."""
    m = remap.where("id <> leader")
    out = edges.join(m.select("scope", F.col("id").alias("source"), F.col("leader").alias("_s")), ["scope", "source"], "left").join(m.select("scope", F.col("id").alias("target"), F.col("leader").alias("_t")), ["scope", "target"], "left")
    out = out.withColumns({"source": F.coalesce("_s", "source"), "target": F.coalesce("_t", "target"), "_moved": F.col("_s").isNotNull() | F.col("_t").isNotNull()})
    return out.where("not (source = target and _moved)").drop("_s", "_t", "_moved")


def last_per_pair(edges: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """Of rows with equal keys the last by `seq`."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(s) for s in seq])
    return edges.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first by `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def noise_nodes(nodes: DataFrame, edges: DataFrame, least: float = 0.2) -> DataFrame:
    """scope, id: nodes that are neither root nor phantom and have no edge of enough fidelity or any corroboration. nodes(scope, id, is_root, phantom)."""
    good = F.coalesce((F.col("source_fidelity") >= least) | (F.col("corroboration") != "none"), F.lit(False))
    ends = edges.select("scope", F.col("source").alias("id"), good.alias("good")).unionByName(edges.select("scope", F.col("target").alias("id"), good.alias("good")))
    kept = ends.groupBy("scope", "id").agg(F.bool_or("good").alias("good")).where("good")
    return nodes.where("not is_root and not coalesce(phantom, false)").select("scope", "id").join(kept.select("scope", "id"), ["scope", "id"], "left_anti")


def unsubstantiated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """scope, id: nodes other than the root that are phantom, or whose every edge as a source is uncorroborated (or that have none)."""
    weak = edges.groupBy("scope", F.col("source").alias("id")).agg(F.bool_and(F.col("corroboration").isin("none", "unverified")).alias("weak"))
    out = nodes.where("not is_root").join(weak, ["scope", "id"], "left")
    return out.where(F.coalesce("phantom", F.lit(False)) | F.coalesce("weak", F.lit(True))).select("scope", "id")
