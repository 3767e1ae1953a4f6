from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from citetrail.llm import names as N

WORD = st.text(alphabet="abc", min_size=0, max_size=9)


def slow(a, b):
    d = {(-1, -1): 0}
    for i in range(len(a)):
        d[i, -1] = i + 1
    for j in range(len(b)):
        d[-1, j] = j + 1
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@settings(max_examples=400, deadline=None)
@given(WORD, WORD, st.integers(1, 3))
def test_edit_distance(a, b, k):
    assert N.edit_distance(a, b, k) == min(k + 1, slow(a, b))


def test_similar_strings(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(4, 9))) for _ in range(160)})
    want = {(a, b) for a in words for b in words if a != b and slow(a, b) <= 1}
    got = N.similar_strings(spark.createDataFrame([(w,) for w in [*words, *words[:9], None, "ab"]], "s string?".replace("?", "")))
    assert {(r.a, r.b) for r in got.collect()} == want


def test_similar_strings_of_all_lengths(spark):
    """Short ones by deletions, long ones by segments, and pairs of one of each; also for two edits."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(4, 12))) for _ in range(150)})
    for k in (1, 2):
        want = {(a, b) for a in words for b in words if a != b and slow(a, b) <= k}
        got = N.similar_strings(spark.createDataFrame([(w,) for w in words], "s string"), k)
        assert {(r.a, r.b) for r in got.collect()} == want
    assert {len(a) <= N.SHORT for a, b in want if len(a) != len(b)} == {True, False}


def test_numbers_and_contractions(spark):
    a = ["Studio 54", "STUDIO 54 Ltd", "54 Studio"]
    b = ["Studio 55"]
    c = ["Velm Chronicle", "Velm Chrncl", "Chron., Velm"]
    values = [(v, 4 if v in (a[0], b[0], c[0]) else 1) for v in [*a, *b, *c]]
    assert linked(spark, values, {v: "organization" for v, _ in values}) == groups(a, c)


def linked(spark, values, kinds=None):
    rows = [(v, "person" if kinds is None else kinds[v], "clash", "clash") for v, n in values for _ in range(n)]
    df = spark.createDataFrame(rows, "name string, kind string, value string, entity string")
    return {(r.name_a, r.name_b) for r in N.name_pairs(N.link_names(df, "name", "kind")).collect()}


def groups(*gs):
    return {tuple(sorted((a, b))) for g in gs for a in g for b in g if a != b}


def test_people(spark):
    a = ["Katherine Mekeririm", "Kate Mekeririm", "Mekeririm, Katherine A.", "MEKERIRIM KATHERINE", "Prof. K. Mekeririm", "Mx Mekeririm", "Katherine Mekerirm", "  Katherine  Mekeririm"]
    b = ["Ulrike Patufofan", "Prof. U. Patufofan"]
    c = ["Margaret Patufofan", "Peggy Patufofan"]
    alone = ["Mx Patufofan", "Report 12/3", "Report 13/3"]
    values = [(v, 5 if v in (a[0], b[0], c[0]) else 1) for v in [*a, *b, *c, *alone]]
    assert linked(spark, [*values, (None, 2), ("", 1), ("  ", 1)], {v: "person" for v, _ in values} | {None: "person", "": "person", "  ": "person"}) == groups(a, b, c)


def test_organisations(spark):
    a = ["University of Zetupeser", "Zetupeser Univ.", "U. of Zetupeser", "The University of Zetueser"]
    b = ["Bravo & Vubrutapam Limited", "Vubrutapam and Bravo Ltd", "Bravo/Vubrutapam"]
    c = ["Department of Soil Science, Hesala", "Hesala Dept. of Soil Sci.", "Dept of Soil Science (Hesala)"]
    places = ["New Castanor", "NEW CASTANOR", "Old Castanor"]
    kinds = {v: "organization" for v in a + b + c} | {v: "place" for v in places} | {b[2]: "concept"}
    assert linked(spark, [(v, 4 if v in (a[0], b[0], c[0]) else 1) for v in kinds], kinds) == groups(a, b, c)


def test_papers(spark):
    a = ["Sorrel Bay Tribune", "Sorre lBay Trib.", "Sorrel Bay Trib.", "S. Bay Tribune", "sorrelbaytribune.example", "Tribune, Sorrel Bay", "Sorrel Bay Tribune Media Group Ltd"]
    b = ["Sorrel Bay Courier", "sorrel-bay-courier.test"]
    df = spark.createDataFrame([(v,) for v in [*a, *b, a[0], b[0], "", None]], "publisher string")
    assert {(r.name_a, r.name_b) for r in N.name_pairs(N.link_names(df, "publisher")).collect()} == groups(a, b)
    assert N.link_names(df.limit(0), "publisher").count() == 0
