"""Column functions on hand-made rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from citetrail.config import PipelineConfig, positive_number
from citetrail.functions import dates, jsonval, levels, pages, text, urls, vector


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize_url(spark):
    cases = {
        "HTTPS://WWW.Example.TEST/a/?utm_source=x&ref=y": "https://www.example.test/a",
        "https://a.test": "https://a.test/",
        "https://a.test/?source=z#top": "https://a.test/",
        "https://a.test:443/x?b=2&a=1&b=1": "https://a.test/x?a=1&b=2&b=1",
        "http://a.test:8080/x/": "http://a.test:8080/x",
        "https://a.test/a/?b=2": "https://a.test/a/?b=2",
        "no url at all": "no url at all",
        "": "",
    }
    assert values(spark, list(cases), urls.normalize_url) == list(cases.values())


def test_admission(spark):
    good = ["https://a.test/story", "https://m.youtube.com/x", "https://a.test/lives", "https://open.spotify.com/"]
    bad = ["ftp://a.test/x", "https://a.test/x.PDF", "https://www.youtube.com/x", "https://a.test/live", "https://a.test/Video/1", "x", ""]
    assert values(spark, good, urls.is_analyzable_url) == [True] * len(good)
    assert values(spark, bad, urls.is_analyzable_url) == [False] * len(bad)


def test_titles(spark):
    assert values(spark, ["https://www.a.test/x/some-long_title.html", "https://a.test/", "x" * 90], urls.title_from_url) == ["some long title", "a.test", "x" * 80]
    assert values(spark, ["https://www.a.test/", "?"], urls.publisher_from_url) == ["a.test", ""]


def test_words_and_shingles(spark):
    assert values(spark, ["The Harbour's cost, and the COST of it", "", None], text.content_words) == [["harbour", "cost"], [], None]
    assert values(spark, ["one two three four five six", "one two", ""], text.content_shingles) == [["one two three four five", "two three four five six"], [], []]
    assert len(values(spark, [" ".join(f"w{i:05d}" for i in range(3000))], text.content_shingles)[0]) == 2996


def chunks(s, threshold=8000, target=3000, overlap=200):
    import re

    if len(s) <= threshold:
        return [s]
    out, cur = [], ""
    for p in re.split(r"\n{2,}", s):
        if len(cur) + len(p) > target and cur:
            out.append(cur.strip())
            cur = cur[-overlap:] + "\n\n" + p
        else:
            cur += ("\n\n" if cur else "") + p
    return out + ([cur.strip()] if cur.strip() else [])


def test_chunks(spark):
    cases = ["a" * 8000, "b" * 8001, "\n\n".join("word " * n for n in (100, 700, 10, 900, 300, 650)), ("x" * 2999 + " \n\n\n") * 4, ""]
    assert values(spark, cases, text.chunk_markdown) == [chunks(c) for c in cases]


def test_links(spark):
    md = "see [A b](https://x.test/1) and [again](https://x.test/1), [two](http://y.test/) [rel](/z)"
    got = values(spark, [md, ""], text.inline_links)
    assert [tuple(x) for x in got[0]] == [("https://x.test/1", "A b"), ("http://y.test/", "two")] and got[1] == []


def test_pages(spark):
    prose = "Officials said so. " * 20
    assert values(spark, [prose, "[a](b) short [c](d)" * 50], pages.is_link_heavy) == [False, True]
    sell = "Get started. Try it free. Contact sales. "
    assert values(spark, [sell * 3, sell + "He said no."], lambda x: pages.is_product_page(F.lit("https://a.test/x"), x)) == [True, False]
    assert values(spark, ["https://a.test/pricing", "https://a.test/price"], lambda x: pages.is_product_page(x, F.lit("text"))) == [True, False]
    assert values(spark, ["What is a quay", "A quay"], lambda x: pages.is_knowledge_base(F.lit("https://a.test/x"), x, F.lit("text"))) == [True, False]
    body = "\n".join(["line"] * 10 + ["## Related stories", "x"])
    assert values(spark, [body, "## Trending\n" + "a\n" * 9], pages.strip_related) == ["\n".join(["line"] * 10), "## Trending\n" + "a\n" * 9]


def test_densest_block(spark):
    nav, para = "[a](b) [c](d)", "A long paragraph of text that says something about the harbour. " * 3
    md = "\n".join([nav] * 8 + [para, "", para] + [nav] * 8)
    assert values(spark, [md, para, "", None], pages.densest_block) == ["\n".join([para, "", para]).strip(), para, "", None]
    weights = values(spark, ["", "  ", "short", "x" * 200, "x" * 95 + " [abcd](y)"], pages.line_weights)
    assert weights == [[0], [0], [-1000], [200_000], [70_000]]


def test_densest_run_is_the_heaviest(spark):
    """Against all runs tried one by one, on random weights with many ties and weak lines."""
    rng = random.Random(4)
    cases = [[rng.choice([-1, 0, 0, 0, -1, 0.5, 3, 5, 7, 20, -40]) for _ in range(rng.randrange(0, 40))] for _ in range(300)]

    def slow(w):
        best = None
        for i in range(len(w)):
            for j in range(i, len(w)):
                weak = [x < 1 for x in w[i : j + 1]]
                if w[i] >= 5 and not any(all(weak[k : k + 6]) for k in range(len(weak) - 5)):
                    key = (-sum(w[i : j + 1]), i, j)
                    best = key if best is None or key < best else best
        return best and best[1:]

    got = values(spark, [[int(x * 1000) for x in w] for w in cases], pages.densest_run, "array<bigint>")
    assert [g and tuple(g) for g in got] == [slow(w) for w in cases]


def test_json(spark):
    raw = ['{"a": 1.7, "b": "0.5", "c": ["x", 1, null], "sourceType": "opinion"}', 'noise {"a": -3} tail', "[1]", None, "{bad"]
    assert values(spark, raw, lambda x: jsonval.unit_number(jsonval.parse_json(x), "$.a")) == [1.0, 0.0, 0.5, 0.5, 0.5]
    assert values(spark, raw, lambda x: jsonval.unit_number(jsonval.parse_json(x), "$.b"))[0] == 0.5
    assert values(spark, raw, lambda x: jsonval.texts(jsonval.parse_json(x), "$.c")) == [["x"], [], [], [], []]
    assert values(spark, raw, lambda x: jsonval.source_type(jsonval.parse_json(x))) == ["opinion"] + ["secondary-reporting"] * 4
    assert values(spark, ['{"matches": [1, 3, "2", 3]}'], jsonval.matches) == [[0, 2]]


def test_dates(spark):
    d = dt.date(2024, 1, 1)
    gaps = [0, 14, 15, 44, 45, 60, -14, -15]
    df = spark.createDataFrame([(i, d, d + dt.timedelta(days=g)) for i, g in enumerate(gaps)], "i int, a date, b date")
    got = [r.g for r in df.select("i", dates.temporal_gap(F.col("a"), F.col("b")).alias("g")).orderBy("i").collect()]
    assert got == [None, None, "~2 weeks older", "~6 weeks older", "~2 months older", "~2 months older", None, "~2 weeks newer"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r.c for r in df.select(vector.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1:] == [0.0, None]
    same = [r.c for r in df.select(vector.dot(vector.unit(F.col("a")), vector.unit(F.col("b"))).alias("c")).collect()]
    assert same[0] == pytest.approx(0.5**0.5) and same[1:] == [None, None]
    assert values(spark, [[1.0, 2.0], [0.0, 0.0], [], None, [float("nan"), 1.0], [None, 1.0]], vector.is_usable, "array<double>") == [True] + [False] * 5


def test_levels_and_config(spark):
    assert values(spark, [0.75, 0.5, 0.49], levels.fidelity_level, "double") == ["high", "medium", "low"]
    assert values(spark, [1, 2], lambda x: levels.counted(x, "source"), "int") == ["1 source", "2 sources"]
    assert [positive_number(x, 7) for x in ("3", "2.5", "0", "-1", "x", None, "inf", " 4 ")] == [3, 2.5, 7, 7, 7, 7, 7, 4]
    assert PipelineConfig().max_urls == 50
