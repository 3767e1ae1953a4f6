"""A whole analysis replayed from a small corpus and canned replies."""

from __future__ import annotations

import json

from citetrail.models.replay import ReplayModel
from citetrail.pipeline import run
from citetrail.schema import PAGE
from citetrail.sources.corpus import CorpusSource
from citetrail.sources.store import analysis_by_url, entity_table, read, reassemble, resolve_triples, seed

BODY = "Officials said that Harbour Trust spent 40 million marks on the new quay. " * 12


def page(url, title, extra="", ok=True):
    return (url, ok, BODY + extra, title, [], {}, None)


def triple(s, o, p="funds"):
    return {"subject": s, "subjectType": "organization", "predicate": p, "object": o, "objectType": "place"}


def reply(operator, subject, **fields):
    return (None, operator, subject, json.dumps(fields))


def test_replay(spark, tmp_path):
    a, b, c, d = "https://a.example/story", "https://b.example/report", "https://c.example/note", "https://d.example/wiki/quay"
    corpus = [
        page(a, "Quay cost rises", f" See [Harbour Trust]({c}). " + "alpha " * 300),
        page(b, "Quay cost report", "bravo " * 300),
        page(c, "Quay cost note", "charlie " * 300),
        page(d, "Quay", "delta " * 300),
        page("https://e.example/short", "Short", ok=True)[:2] + ("Too short.",) + ("Quay cost", [], {}, None),
    ]
    pages = spark.createDataFrame(corpus, PAGE)
    unlinked = [{"description": "harbour survey of the quay", "canonicalKey": "survey", "sourceType": "primary-study", "publisher": "Survey", "date": ""}, {"description": "no key", "canonicalKey": ""}]
    claim = lambda t, *ts: {"claim": t, "entities": ["Harbour Trust"], "attribution": "", "triples": list(ts)}
    replies = [
        reply("classify", a, title="Quay cost rises", sourceType="opinion", snippet="quay cost", sourceUrls=[b, d, "https://e.example/short", "https://gone.example/x", a], unlinkedSources=unlinked),
        reply("classify", b, title="Quay cost report", sourceType="primary-study", date="2024-01-01"),
        reply("classify", c, title="Quay cost note", sourceType="press-release"),
        reply("classify", d, title="Quay", sourceType="opinion"),
        reply("claims", "Quay cost rises", claims=[claim("Trust pays.", triple("Trust", "Quay"), triple("City", "Quay"))]),
        reply("claims", "Quay cost report", claims=[claim("Trust paid.", triple("Quay", "trust"), triple("city", "QUAY"))]),
        reply("claims", "Quay cost note", claims=[claim("Nothing.", triple("X", "Y"))]),
        reply("edge", "article-s-1", sourceFidelity=0.9, editorialization=1.7, concerns=["x", 3]),
        reply("phantom", "p-1 article", sourceFidelity="0.4", attributedClaims=["said so"]),
        reply("summary", '{"overall_fidelity":0.58,"concern_count":2,"strong_corroboration":1,"weak_corroboration":4,"n_edges":5,"unverified_claims":["Nothing."]}', text="ok"),
    ]
    model = ReplayModel(spark.createDataFrame(replies, "key string, operator string, subject string, raw string"), dims=4)
    roots = spark.createDataFrame([("t", a), ("u", "https://missing.example/")], "scope string, url string")
    out = run(roots, CorpusSource(pages), model)
    assert [tuple(r) for r in out["failed"].collect()] == [("u", "https://missing.example/")]
    nodes = {r.node: r for r in out["nodes"].collect()}
    kinds = {r.url: (n, r.source_type, r.unscrapable) for n, r in nodes.items()}
    assert kinds[b][1] == "primary-study" and kinds[d][1] == "data-source" and kinds["https://e.example/short"][2]
    assert nodes["p-1"].phantom_key == "survey" and nodes["p-1"].attributed_claims == ["said so"] and nodes["p-1"].snippet == "said so"
    edges = {(r.source, r.target): r for r in out["edges"].collect()}
    strong = edges[kinds[b][0], "article"]
    assert (strong.corroboration, strong.source_fidelity, strong.editorialization, strong.concerns) == ("strong", 0.9, 1.0, ["x"])
    assert edges[kinds[c][0], "article"].corroboration == "none" and edges["p-1", "article"].source_fidelity == 0.5
    assert edges[kinds["https://e.example/short"][0], "article"].corroboration == "unverified"
    s = out["summary"].first()
    assert (s.strong_corroboration, s.weak_corroboration, s.n_edges) == (1, 4, 5) and s.unverified_claims == ["Nothing."]
    assert len([r for r in out["claims"].collect()]) == 3 and out["triples"].count() == 5
    path = str(tmp_path / "store")
    assert seed(spark, path, roots, out) and seed(spark, path, roots, out) == ""
    one = analysis_by_url(spark, path, a).first()
    assert one.article.title == "Quay cost rises" and one.summary.text == "ok" and one.summary.unverified_claims == ["Nothing."]
    got = {n.id: n for n in one.nodes}
    assert set(got) == set(nodes) and got["p-1"].attributed_claims == ["said so"] and got["article"].attributed_claims is None and got["article"].phantom_key is None
    assert next(e for e in one.edges if e.id == "article-s-1").concerns == ["x"] and [c.claim for c in one.claims["article"]] == ["Trust pays."]
    assert analysis_by_url(spark, path, "https://missing.example/").count() == 0
    assert read(spark, path, "entities").count() > 0 and {r.subject_key for r in read(spark, path, "triples").collect()} >= {"trust", "city"}


def test_store(spark, tmp_path):
    claims = spark.createDataFrame([("t", 0, ["Quay", "trust"]), ("t", 1, ["TRUST", ""])], "scope string, ord int, entities array<string>")
    triples = spark.createDataFrame([("t", 1, 0, "Trust", "organization", "quay", "place"), ("t", 1, 1, "Nobody", "person", "", "place")], "scope string, ord int, pos int, subject string, subjectType string, object string, objectType string")
    entities = entity_table(triples, claims)
    assert {(r.key, r.name, r.type) for r in entities.collect()} == {("quay", "Quay", "concept"), ("trust", "trust", "concept"), ("nobody", "Nobody", "person")}
    assert resolve_triples(triples, entities).count() == 1


def test_reassemble(spark):
    """Null numbers are 0, a summary needs a text, concerns stand in their order, only phantoms have what phantoms have."""
    heads = [("t", "https://a.test/", "T", "P", None, None, "fine", None, 2, None, 1, '["x", "y"]'), ("u", "https://b.test/", "U", None, None, None, "", 0.5, 1, 1, 1, "no json")]
    analyses = spark.createDataFrame(heads, "scope string, article_url string, article_title string, article_publisher string, article_date string, article_snippet string, summary_text string, summary_fidelity double, summary_concern_count int, summary_strong_corroboration int, summary_weak_corroboration int, summary_unverified_claims string")
    nodes = spark.createDataFrame([("t", "article", None, "key", False, 1), ("t", "p-1", None, "key", True, 2)], "scope string, node string, url string, phantom_key string, phantom boolean, ord int").selectExpr("*", "node as title", "'' as publisher", "'' as date", "'' as source_type", "'' as snippet")
    edges = spark.createDataFrame([("t", "e", "p-1", "article", 0.5, 0.1, "opinion", "none", 1)], "scope string, edge_id string, source string, target string, source_fidelity double, editorialization double, metric_source_type string, corroboration string, ord int")
    concerns = spark.createDataFrame([("t", "e", 1, "b"), ("t", "e", 0, "z"), ("t", "e", 2, "a")], "scope string, edge_id string, sort_order int, concern string")
    claims = spark.createDataFrame([("t", "article", "late", "", 2), ("t", "article", "early", "A", 1)], "scope string, node string, claim_text string, attribution string, ord int")
    got = {r.scope: r for r in reassemble({"analyses": analyses, "nodes": nodes, "edges": edges, "concerns": concerns, "claims": claims}).collect()}
    t = got["t"]
    assert (t.summary.overall_fidelity, t.summary.concern_count, t.summary.strong_corroboration, t.summary.unverified_claims) == (0.0, 2, 0, ["x", "y"])
    assert t.edges[0].concerns == ["z", "b", "a"] and [c.claim for c in t.claims["article"]] == ["early", "late"] and t.claims["article"][0].entities == []
    assert [(n.id, n.phantom_key, n.attributed_claims) for n in t.nodes] == [("article", None, None), ("p-1", "key", [])]
    assert got["u"].summary is None and got["u"].nodes is None
