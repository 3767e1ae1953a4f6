"""Mixing sources to target weights (problem 9), by Efraimidis-Spirakis sampling.

A source's budget is its part of the mix's tokens. Complete epochs over the source come first; the rest of the budget is
filled by documents in the order of exponential keys scaled by their quality weights. Prefix sums are taken over buckets
of keys; the bucket in which a budget ends is cut into buckets again until it has few documents, however the weights lie,
and only those are sorted, so no source is ever ordered in one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citetrail.llm.tokens import VOCABULARY, token_sizes
from citetrail.runtime import join_sized, materialise

#: Most documents of the bucket in which a budget ends; it is sorted in one task.
BUCKET_DOCS = 1_000
#: Buckets that a range of keys is cut into, and the most rounds of that (only documents of one id have equal keys).
BUCKETS, ROUNDS = 1_024, 12


def sampling_keys(sizes: DataFrame, seed: int = 1) -> DataFrame:
    """Adds `key`: -ln(u) / weight with u from a hash of the id, so the least keys are a weighted sample without replacement."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return sizes.withColumn("key", -F.log(u) / F.greatest("weight", F.lit(1e-6)))


def plan_mix(targets: DataFrame, totals: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """mix_name, source, target_share, target_part, max_repeats, source_tokens, budget, epochs, remainder: per mix and source what is to be taken.

    Parts are shares over the sum of the shares of sources that exist. Without total_tokens a mix is as large as its
    parts can be kept exactly under the caps on repeats. Sources with no tokens, shares not above 0 and caps below 1
    get a budget of 0. A source given twice in a mix adds its shares, with the smaller cap.
    """
    t = targets.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.sum(F.when(F.col("target_share") > 0, F.col("target_share")).otherwise(0.0)).alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    t = t.join(totals, "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    usable = (F.col("source_tokens") > 0) & (F.col("max_repeats") >= 1) & (F.col("target_share") > 0)
    mix = Window.partitionBy("mix_name")
    part = F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(mix)).otherwise(0.0)
    t = t.withColumn("target_part", part)
    most = F.min(F.when(F.col("target_part") > 0, F.col("max_repeats") * F.col("source_tokens") / F.col("target_part"))).over(mix)
    t = t.withColumn("mix_tokens", most if total_tokens is None else F.lit(float(total_tokens)))
    # A budget cannot exceed the cap, whatever total is asked for.
    t = t.withColumn("budget", F.floor(F.least(F.coalesce(F.col("target_part") * F.col("mix_tokens"), F.lit(0.0)) + 1e-6, (F.col("max_repeats") * F.col("source_tokens")).cast("double"))).cast("long"))
    t = t.withColumn("budget", F.greatest(F.coalesce("budget", F.lit(0)), F.lit(0)))
    t = t.withColumn("epochs", F.when(F.col("source_tokens") > 0, F.expr("budget div source_tokens")).otherwise(0).cast("int"))
    return t.withColumn("remainder", F.col("budget") - F.col("epochs") * F.col("source_tokens")).drop("mix_tokens")


def budget_ends(sizes: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows of `ranges` with the range of log keys (lo to hi) narrowed to the bucket in which the budget ends, of BUCKET_DOCS documents at most.

    ranges: mix_name, source, remainder, docs, lo, hi, before: the documents in a range and the tokens before it. Each
    round cuts a range into BUCKETS of equal width and sums tokens per bucket on the cluster.
    """
    ranges = materialise(ranges)
    x = F.log("key")
    for _ in range(ROUNDS):
        wide = materialise(ranges.where((F.col("docs") > BUCKET_DOCS) & (F.col("hi") > F.col("lo"))))
        n = wide.count()
        if not n:
            break
        at = join_sized(sizes.select("source", "tokens", "key"), wide.drop("docs"), ["source"], rows=n).where(x.between(F.col("lo"), F.col("hi")))
        bucket = F.least(F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1))
        sums = at.groupBy("mix_name", "source", "remainder", "before", bucket.alias("bucket")).agg(F.sum("tokens").alias("in_bucket"), F.count(F.lit(1)).alias("docs"), F.min(x).alias("lo"), F.max(x).alias("hi"))
        upto = F.sum("in_bucket").over(Window.partitionBy("mix_name", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        of = Window.partitionBy("mix_name", "source")
        sums = sums.withColumn("before", F.col("before") + F.coalesce(upto, F.lit(0))).withColumn("edge", F.max(F.when(F.col("before") < F.col("remainder"), F.col("bucket"))).over(of))
        # With the buckets after it while they are few: small documents there fill what a large one leaves.
        sums = sums.where("bucket >= edge").withColumn("upto", F.sum("docs").over(of.orderBy("bucket"))).where((F.col("bucket") == F.col("edge")) | (F.col("upto") <= BUCKET_DOCS))
        last = sums.groupBy("mix_name", "source").agg(F.first("remainder").alias("remainder"), F.sum("docs").alias("docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("before").alias("before"))
        ranges = materialise(ranges.where((F.col("docs") <= BUCKET_DOCS) | (F.col("hi") <= F.col("lo"))).unionByName(last))
    return ranges


def mix_sources(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY, total_tokens: int | None = None, seed: int = 1, quality: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix_name, source, doc_id, tokens, repeats) for each document used, and the report of shares per mix and source.

    quality names a column of weights; without it they are made from the texts (`tokens.token_sizes`).

    Every document of a source is used `epochs` times; those the sample takes once more. In the bucket where the budget
    ends, documents are taken in the order of their keys while they fit what is left. Documents without tokens or source are never used. Rows with
    equal ids are drawn together and counted each. Ties of keys go to the lesser id. Empty tables give empty results.
    Other columns, whatever their names, are not read. `targets` is broadcast while it has few rows.
    """
    sizes = materialise(sampling_keys(token_sizes(docs, doc_id, text, source, vocabulary, quality).where("tokens > 0 and source is not null"), seed))
    totals = materialise(sizes.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count(F.lit(1)).alias("docs"), F.min(F.log("key")).alias("lo"), F.max(F.log("key")).alias("hi")))
    plan = materialise(plan_mix(targets, totals.select("source", "source_tokens"), total_tokens))
    ends = budget_ends(sizes, plan.where("remainder > 0").join(totals.drop("source_tokens"), "source").select("mix_name", "source", "remainder", "docs", "lo", "hi", F.lit(0).cast("long").alias("before")))
    todo = materialise(plan.where("budget > 0").join(ends.drop("remainder", "docs"), ["mix_name", "source"], "left").select("mix_name", "source", "epochs", "remainder", "lo", "hi", "before"))
    used = join_sized(sizes, todo, ["source"]).withColumn("edge", F.log("key").between(F.col("lo"), F.col("hi")))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "doc_id"], ignore_index=True)
        room, more = int(pdf["remainder"].iloc[0] - pdf["before"].iloc[0]), []
        for n in pdf["tokens"]:
            more.append(int(n <= room))
            room -= n if n <= room else 0
        return pdf[["mix_name", "source", "doc_id", "tokens"]].assign(repeats=pdf["epochs"] + more)

    id_kind = dict(sizes.dtypes)["doc_id"]
    more = used.where("edge").select("mix_name", "source", "doc_id", "tokens", "key", "epochs", "remainder", "before").groupBy("mix_name", "source").applyInPandas(fill, f"mix_name string, source string, doc_id {id_kind}, tokens long, repeats int")
    whole = used.where("not coalesce(edge, false)").select("mix_name", "source", "doc_id", "tokens", (F.col("epochs") + F.coalesce((F.log("key") < F.col("lo")).cast("int"), F.lit(0))).alias("repeats"))
    mixed = whole.unionByName(more).where("repeats > 0")
    taken = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    report = plan.join(taken, ["mix_name", "source"], "left").select(
        "mix_name", "source", "target_share", F.round("target_part", 6).alias("target_part"), "max_repeats", "source_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.round(F.coalesce(F.col("tokens") / F.sum("tokens").over(Window.partitionBy("mix_name")), F.lit(0.0)), 6).alias("actual_part"),
    )
    return mixed, report
