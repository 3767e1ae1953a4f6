"""Shared tables, sized joins and keys."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from citetrail.runtime import Growing, drop, join_sized, materialise, node_key, scratch_root


def test_materialise_and_drop(spark):
    df = materialise(spark.range(10).withColumn("x", F.col("id") * 2))
    path = df._scratch_path
    assert path.startswith(scratch_root(spark).rstrip("/")) and df.count() == 10
    local = path.removeprefix("file://")
    assert os.path.isdir(local)
    drop(df)
    assert not os.path.exists(local)
    drop(df)
    drop(None)


def test_growing(spark):
    g = Growing(spark.range(3))
    assert g.add(spark.range(3, 5)).count() == 2
    assert g.add(spark.range(0)).isEmpty()
    assert sorted(r.id for r in g.read().collect()) == [0, 1, 2, 3, 4]


def test_join_sized(spark):
    left, right = spark.range(100), materialise(spark.range(10))
    for limit, plan in ((1000, "Broadcast"), (1, "SortMerge")):
        joined = join_sized(left, right, ["id"], limit=limit)
        assert joined.count() == 10 and plan in joined._jdf.queryExecution().sparkPlan().toString()


def test_node_key(spark):
    rows = [(" S-1 ",), ("﻿s-1\t",), ("",), (" 　",), (None,)]
    assert [r.k for r in spark.createDataFrame(rows, "x string").select(node_key("x").alias("k")).collect()] == ["s-1", "s-1", "", "", None]
