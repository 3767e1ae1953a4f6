"""References to records that do not exist (problem 3).

Parent and child keys are put in one long form (parent table's key, a flag, a time), grouped by key with map-side
combine, and keys are kept that lack a parent, had a reference before their first parent, or whose last parent row
records a deletion. Only rows of kept keys are read again, so no group is ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetrail.runtime import node_key


@dataclass(frozen=True)
class Child:
    """One referencing table: its name in the result, its rows, and its columns."""

    name: str
    rows: DataFrame
    scope: str = "analysis_id"
    key: str = "source_node_id"
    row_id: str = "id"
    at: str = "loaded_at"


def _children(children: Sequence[Child]) -> DataFrame:
    parts = [
        c.rows.select(
            F.lit(c.name).alias("ref_table"), F.col(c.row_id).alias("ref_id"), F.col(c.scope).alias("scope"), node_key(c.key).alias("key"), F.col(c.at).alias("at")
        ).where("key <> ''")
        for c in children
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphan_references(parents: DataFrame, children: Sequence[Child], scope: str = "analysis_id", key: str = "node_id", at: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """ref_table, ref_id, period, reason: every reference that names no record at its time, or one since deleted.

    Keys are compared trimmed and in lower case, within equal scopes. Null or blank references are no references. A null
    scope matches nothing, so such references are orphans. A parent without a load time is never there yet. A reference
    without a time counts as before every parent and has a null period. When several parent rows share the greatest load
    time, any of them being deleted counts. Empty tables give an empty result (no parents: every reference is an
    orphan). Other columns, whatever their names, are not read. Repeated rows give one row.
    """
    parent = parents.select(F.col(scope).alias("scope"), node_key(key).alias("key"), F.col(at).alias("p_at"), F.col(deleted).isNotNull().alias("gone")).where(
        "scope is not null and key <> '' and p_at is not null"
    )
    refs = _children(children)
    long = parent.select("scope", "key", "p_at", F.struct("p_at", "gone").alias("p_last"), F.lit(None).cast("timestamp").alias("c_at"), F.lit(False).alias("c_untimed")).unionByName(
        refs.where("scope is not null").select(
            "scope",
            "key",
            F.lit(None).cast("timestamp").alias("p_at"),
            F.lit(None).cast("struct<p_at:timestamp,gone:boolean>").alias("p_last"),
            F.col("at").alias("c_at"),
            F.col("at").isNull().alias("c_untimed"),
        )
    )
    keys = (
        long.groupBy("scope", "key")
        .agg(F.min("p_at").alias("first_at"), F.max("p_last").alias("last"), F.min("c_at").alias("c_first"), F.max("c_untimed").alias("c_untimed"), F.count_if(F.col("p_last").isNull()).alias("n_refs"))
        .where("n_refs > 0 and (first_at is null or last.gone or c_first < first_at or c_untimed)")
        .select("scope", "key", "first_at", F.coalesce(F.col("last.gone"), F.lit(False)).alias("gone"))
    )
    scoped = refs.where("scope is not null").join(keys, ["scope", "key"]).where("gone or first_at is null or at is null or first_at > at")
    unscoped = refs.where("scope is null").withColumns({"first_at": F.lit(None).cast("timestamp"), "gone": F.lit(False)})
    reason = F.when(F.col("gone"), "deleted").when(F.col("first_at").isNull(), "missing").otherwise("late")
    return scoped.unionByName(unscoped.select(*scoped.columns)).select("ref_table", "ref_id", F.date_format("at", "yyyy-MM").alias("period"), reason.alias("reason")).distinct()


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """ref_table, period, reason, n_refs: orphan references per table and period. An empty input gives an empty result."""
    return orphans.groupBy("ref_table", "period", "reason").agg(F.count_distinct("ref_id").alias("n_refs"))
