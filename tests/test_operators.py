"""Graph operators against plain restatements on small random inputs."""

from __future__ import annotations

import random

from citetrail.operators import consolidate, corroboration, frontier, tree


def greedy(n, pairs):
    lead, gone = {i: i for i in range(n)}, set()
    for i in range(n):
        if i in gone:
            continue
        for j in range(i + 1, n):
            if j not in gone and (i, j) in pairs:
                lead[j] = i
                gone.add(j)
    return lead


def test_leaders(spark):
    rng = random.Random(4)
    nodes, pairs, want = [], [], {}
    for s in range(25):
        n = rng.randrange(1, 14)
        p = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.25}
        nodes += [(s, i, i) for i in range(n)]
        pairs += [(s, *((i, j) if rng.random() < 0.5 else (j, i))) for i, j in p]
        want |= {(s, i): x for i, x in greedy(n, p).items()}
    got = consolidate.leaders(spark.createDataFrame(nodes, "scope int, id int, ord int"), spark.createDataFrame(pairs, "scope int, a int, b int"))
    assert {(r.scope, r.id): r.leader for r in got.collect()} == want


def test_leaders_chain(spark):
    nodes = spark.createDataFrame([(0, x, i) for i, x in enumerate("abc")], "scope int, id string, ord int")
    got = consolidate.leaders(nodes, spark.createDataFrame([(0, "a", "b"), (0, "b", "c")], "scope int, a string, b string"))
    assert {r.id: r.leader for r in got.collect()} == {"a": "a", "b": "a", "c": "c"}
    assert consolidate.leaders(nodes, spark.createDataFrame([], "scope int, a string, b string")).count() == 3


def test_similar_sets(spark):
    rng = random.Random(5)
    rows = [(s, i, i, sorted({f"w{rng.randrange(12)}" for _ in range(rng.randrange(0, 9))})) for s in range(3) for i in range(40)]
    want = {(s, i, t) for s, i, _, a in rows for z, t, _, b in rows if s == z and i < t and a and b and len({*a} & {*b}) / len({*a} | {*b}) >= 0.5}
    got = consolidate.similar_sets(spark.createDataFrame(rows, "scope int, id int, ord int, items array<string>"), 0.5)
    assert {(r.scope, r.a, r.b) for r in got.collect()} == want
    assert consolidate.similar_sets(spark.createDataFrame([], "scope int, id int, ord int, items array<string>"), 0.5).count() == 0


def test_corroboration(spark):
    edges = spark.createDataFrame([("t", f"{a}{b}", a, b) for a, b in ("ab", "ba", "ac", "ad", "ae")], "scope string, edge_id string, source string, target string")
    triples = [("t", "a", "X", "Y", "p"), ("t", "a", "y", "x", "q"), ("t", "b", "x", "y", "r"), ("t", "c", "u", "v", "s")]
    claims = [("t", "a", [1.0, 0.0]), ("t", "b", None), ("t", "c", [0.0, 0.0]), ("t", "d", [1.0, 0.1])]
    got = corroboration.corroboration(edges, spark.createDataFrame(claims, "scope string, node string, embedding array<float>"), spark.createDataFrame(triples, "scope string, node string, subject string, object string, predicate string"))
    assert {r.edge_id: r.corroboration for r in got.collect()} == {"ab": "strong", "ba": "partial", "ac": "none", "ad": "partial", "ae": "unverified"}


def test_edges(spark):
    edges = spark.createDataFrame([("t", "1", "a", "b", 1), ("t", "2", "c", "b", 2), ("t", "3", "c", "a", 3)], "scope string, edge_id string, source string, target string, seq int")
    moved = consolidate.redirect_edges(edges, spark.createDataFrame([("t", "c", "a"), ("t", "b", "b")], "scope string, id string, leader string"))
    last = consolidate.last_per_pair(moved, ["scope", "source", "target"], ["seq"])
    assert [(r.edge_id, r.source, r.target) for r in last.collect()] == [("2", "a", "b")]


def test_prune(spark):
    nodes = spark.createDataFrame([("t", "article", True, False), ("t", "x", False, False), ("t", "y", False, None), ("t", "p", False, True)], "scope string, id string, is_root boolean, phantom boolean")
    edges = spark.createDataFrame([("t", "x", "article", 0.19, "none"), ("t", "y", "article", 0.2, "none")], "scope string, source string, target string, source_fidelity double, corroboration string")
    assert [r.id for r in consolidate.noise_nodes(nodes, edges).collect()] == ["x"]
    assert sorted(r.id for r in consolidate.unsubstantiated_nodes(nodes, edges).collect()) == ["p", "x", "y"]


def test_budgets(spark):
    rows = [("t", "a", 1, i, k) for i, k in enumerate(["k1", "", "k1", "k2", "k3", "k4"])] + [("t", "b", 2, i, f"m{i}") for i in range(4)]
    m = spark.createDataFrame(rows, "scope string, parent string, parent_ord int, pos int, key string")
    got = [(r.parent, r.key) for r in frontier.phantom_edges(m, 5, 5).orderBy("parent_ord", "pos").collect()]
    assert got == [("a", "k1"), ("a", "k2"), ("a", "k3"), ("b", "m0"), ("b", "m1")]
    c = spark.createDataFrame([("t", i, p) for i, p in enumerate([50, 100, 50, 100])], "scope string, ord int, priority int")
    assert [r.ord for r in frontier.top_candidates(c, 3).orderBy("rank").collect()] == [1, 3, 0]


def test_gather(spark):
    links = spark.createDataFrame([("t", "https://a.test/1", "p", 100, 0), ("t", "https://a.test/1#x", "q", 50, 1), ("t", "https://root.test/", "p", 100, 2), ("t", "https://seen.test/", "q", 100, 3), ("t", "https://a.test/x.pdf", "q", 100, 4)], "scope string, url string, parent string, priority int, ord int")
    visited = spark.createDataFrame([("t", "https://root.test/"), ("t", "https://seen.test/")], "scope string, norm_url string")
    parents = spark.createDataFrame([("t", "https://seen.test/", "z")], "scope string, norm_url string, parent string")
    new, all_parents = frontier.gather_candidates(links, visited, parents)
    assert [(r.norm_url, r.priority) for r in new.collect()] == [("https://a.test/1", 100)]
    assert {(r.norm_url, r.parent) for r in all_parents.collect()} == {("https://seen.test/", "z"), ("https://seen.test/", "q"), ("https://a.test/1", "p"), ("https://a.test/1", "q")}


def test_tree():
    rows = tree.walk("article", [("1", "a", "article"), ("2", "b", "article"), ("3", "a", "b"), ("4", "b", "a")])
    assert [(d, n) for _, d, n, _, _ in rows] == [(0, "article"), (1, "a"), (2, "b"), (1, "b")]
    assert tree.walk("article", []) == [(0, 0, "article", None, None)]
