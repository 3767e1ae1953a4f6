"""Pairs of similar texts: all of them, and with little moved."""

from __future__ import annotations

import os
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citetrail.functions import text
from citetrail.operators import similar
from citetrail.plans import page_queries


def sets(texts, words, starts=None):
    out = {}
    for i, t in texts:
        w = [x for x in (t or "").split() if len(x) > 2]
        s = frozenset(tuple(w[k : k + words]) for k in range(min(max(len(w) - words + 1, 0), starts or len(w))))
        if s:
            out[s] = min(i, out.get(s, i))
    return [(i, s) for s, i in out.items()]


def families(rng, n, length, vocabulary):
    texts = []
    while len(texts) < n:
        base = [f"word{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, length))]
        for _ in range(rng.randrange(1, 6)):
            texts.append(" ".join(x if rng.random() > rng.choice([0, 0.02, 0.1]) else f"word{rng.randrange(vocabulary)}" for x in base))
    return texts[:n]


def test_all_pairs(spark, tmp_path):
    rng = random.Random(3)
    texts = families(rng, 250, 60, 400) + families(rng, 30, 9, 4) + families(rng, 4, 4_000, 100_000) + [None, "", "a bc de"]
    texts += [t and t + " " for t in texts[:40]] + texts[:20]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d, want = str(tmp_path), {}
    for least, words, starts in ((0.8, 5, None), (0.5, 3, 2_000)):
        s = sets(rows, words, starts)
        want[words] = {(min(a, b), max(a, b)): round(len(x & y) / len(x | y), 6) for k, (a, x) in enumerate(s) for b, y in s[:k] if len(x & y) / len(x | y) >= least}
    assert {(r.set_a, r.set_b): r.jaccard for r in page_queries.same_article_pairs(spark, d).collect()} == want[3] != {}
    links = [i for p in want[5] for i in p]
    assert {r.set_doc: r.n_links for r in page_queries.near_dup_links(spark, d).collect()} == {i: links.count(i) for i in links} != {}


def test_whole_texts(spark, tmp_path):
    """Long texts are the same by all of their runs, not by those of the beginning."""
    rng = random.Random(11)
    part = lambda n: " ".join(f"word{rng.randrange(100_000)}" for _ in range(n))
    begin, rest = part(2_100), part(6_000)
    texts = [f"{begin} {part(5_000)}", f"{begin} {part(5_000)}", f"{part(2_100)} {rest}", f"{part(2_100)} {rest}", f"{begin} {rest}", f"{begin} {rest} {part(9)}"]
    rows = list(enumerate(texts + families(rng, 4, 4_000, 100_000) + families(rng, 40, 60, 400)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d, want = str(tmp_path), {}
    for least, words in ((0.8, 5), (0.5, 3)):
        s = sets(rows, words)
        want[words] = {(min(a, b), max(a, b)): round(len(x & y) / len(x | y), 6) for k, (a, x) in enumerate(s) for b, y in s[:k] if len(x & y) / len(x | y) >= least}
    assert {(2, 3), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5)} <= set(want[3]) and (0, 1) not in want[3]
    assert {(r.set_a, r.set_b): r.jaccard for r in page_queries.same_article_pairs(spark, d).collect()} == want[3]
    links = [i for p in want[5] for i in p]
    assert {r.set_doc: r.n_links for r in page_queries.near_dup_links(spark, d).collect()} == {i: links.count(i) for i in links} != {}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    assert {(a, b): j for a, b, j in con.sql(page_queries.SQL["same_article_pairs"]).fetchall()} == want[3]


def test_word_hashes(spark):
    rng = random.Random(2)
    signs = list("abcz019é\u0301 \n.-µßИ模具コートที่นี่विधि\u0e31\u1039က𠀀😀")
    texts = ["", "Ein Überzug, 3 mm", "ab abc abcd", "ที่นี่ abc", "\u0301\u0e31\u0301a", "x" * 5_000] + ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("low"), text.plain_words(F.col("t")).alias("p"), text.script_words(F.col("t")).alias("s")).collect()
    for scripts, name in ((None, "p"), (similar.script_classes(spark), "s")):
        low = pa.array(["zzz"] + [r.low for r in df])[1:]
        h, off = similar.word_hashes(low, scripts)
        assert [len(r[name]) for r in df] == [int(b - a) for a, b in zip(off[:-1], off[1:])]
        pairs = {(w, int(x)) for r, a in zip(df, off) for w, x in zip(r[name], h[a:])}
        assert len(pairs) == len({w for w, _ in pairs}) == len({x for _, x in pairs})


def bytes_moved(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["same_article_pairs", "near_dup_links", "near_dup_classes"])
def test_little_is_moved(spark, tmp_path, name):
    texts = families(random.Random(7), 1_500, 400, 20_000)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    size = sum(os.path.getsize(f"{tmp_path}/documents.parquet/{f}") for f in os.listdir(f"{tmp_path}/documents.parquet"))
    before = bytes_moved(spark)
    getattr(page_queries, name)(spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    assert bytes_moved(spark) - before < 4 * size
