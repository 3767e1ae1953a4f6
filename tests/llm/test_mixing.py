from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from citetrail.llm import mixing as M
from citetrail.llm.tokens import VOCABULARY, token_sizes

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


def docs(spark):
    rows = [(i, f"word{i} more words here and there", "big" if i < 300 else "small", 1) for i in range(330)] + [(900, "", "big", 1), (901, None, "small", 1), (902, "text", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")


def test_mix(spark):
    targets = spark.createDataFrame([("m", "big", 0.5, 2), ("m", "small", 0.5, 3), ("m", "missing", 0.2, 3), ("n", "big", 3.0, 1), ("n", "small", 1.0, 4), ("o", "big", None, 1), ("o", "small", 1.0, 0)], "mix_name string, source string, target_share double, max_repeats int")
    mixed, report = M.mix_sources(docs(spark), targets)
    rep = {(r.mix_name, r.source): r for r in report.collect()}
    assert abs(rep["m", "big"].actual_part - 0.5) < 0.01 and abs(rep["m", "small"].actual_part - 0.5) < 0.01
    assert rep["m", "small"].most_repeats == 3 and rep["m", "big"].most_repeats == 1 and rep["m", "missing"].tokens == 0
    assert abs(rep["n", "big"].actual_part - 0.75) < 0.01
    assert rep["o", "big"].tokens == rep["o", "small"].tokens == 0
    rows = mixed.collect()
    assert len({(r.mix_name, r.source, r.doc_id) for r in rows}) == len(rows) and not {900, 901, 902} & {r.doc_id for r in rows}
    assert sorted(r.doc_id for r in rows if r.mix_name == "m" and r.source == "small") == list(range(300, 330))
    again = {(r.mix_name, r.doc_id, r.repeats) for r in M.mix_sources(docs(spark), targets)[0].collect()}
    assert again == {(r.mix_name, r.doc_id, r.repeats) for r in rows}


def test_budget_and_epochs(spark):
    targets = spark.createDataFrame([("m", "small", 1.0, 5)], "mix_name string, source string, target_share double, max_repeats int")
    size = M.mix_sources(docs(spark), targets)[1].first().source_tokens
    mixed, report = M.mix_sources(docs(spark), targets, total_tokens=int(size * 2.5))
    r = report.first()
    assert abs(r.tokens - size * 2.5) < 20 and {x.repeats for x in mixed.collect()} == {2, 3}
    assert M.mix_sources(docs(spark), targets, total_tokens=size * 99)[1].first().tokens == size * 5


def test_weights(spark):
    sizes = spark.createDataFrame([(i, 1.0 if i % 2 else 0.2) for i in range(4000)], "doc_id long, weight double")
    least = M.sampling_keys(sizes).orderBy("key").limit(800).agg(F.avg("weight")).first()[0]
    assert least > 0.8  # 0.6 without weights


def test_quality_column(spark):
    df = docs(spark).withColumn("q", F.when(F.col("doc_id") % 2 == 0, 1.0).when(F.col("doc_id") % 3 == 0, 0.01))
    got = {(r.doc_id % 2, r.doc_id % 3 == 0): r.weight for r in token_sizes(df, quality="q").collect()}
    assert got[0, True] == got[0, False] == got[1, False] == 1.0 and got[1, True] == 0.05
    plain = {r.doc_id: r.weight for r in token_sizes(docs(spark)).collect()}
    assert 0.05 <= plain[1] < 0.2 and plain[900] == plain[901] == 0.05


def test_narrowing_on_skewed_weights(spark):
    """5 % of the documents weigh a twentieth, and one document has a third of all tokens: the last bucket is small, and what comes before it is right."""
    n = 60_000
    sizes = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") == 7, n).otherwise(1 + F.col("id") % 3).cast("long").alias("tokens"), F.when(F.col("id") % 20 == 0, 0.05).otherwise(1.0).alias("weight"))
    keys = M.sampling_keys(sizes).cache()
    pdf = keys.toPandas().sort_values("key")
    total = int(pdf.tokens.sum())
    lo, hi = keys.agg(F.min(F.log("key")), F.max(F.log("key"))).first()
    for remainder in (1, total // 3, int(total * 0.97), total - 1):
        ranges = spark.createDataFrame([("m", "s", remainder, n, lo, hi, 0)], "mix_name string, source string, remainder long, docs long, lo double, hi double, before long")
        r = M.budget_ends(keys, ranges).first()
        inside = pdf[(np.log(pdf.key) >= r.lo - 1e-12) & (np.log(pdf.key) <= r.hi + 1e-12)]
        assert r.docs == len(inside) <= M.BUCKET_DOCS
        assert r.before == pdf[np.log(pdf.key) < r.lo - 1e-12].tokens.sum() < remainder <= r.before + inside.tokens.sum()


def test_empty(spark):
    targets = spark.createDataFrame([], "mix_name string, source string, target_share double, max_repeats int")
    mixed, report = M.mix_sources(docs(spark), targets)
    assert mixed.count() == 0 and report.count() == 0
    one = spark.createDataFrame([("m", "big", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    mixed, report = M.mix_sources(docs(spark).limit(0), one)
    assert mixed.count() == 0 and report.first().tokens == 0
