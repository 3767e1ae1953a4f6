from __future__ import annotations

import pytest

from citetrail.llm import body

P = "The harbour board said on Monday that the quay would cost more than planned."
SCORES = {body.path_number(b, a, w, k): ((4.0, 0.0) if k != body.LABEL and w != body.NAMED else (0.0, 0.9)) for b in range(5) for a in (0, 1) for w in range(5) for k in range(3)}


def lines_of(md, title=None, url=None, scores=SCORES, variety=None, headings=None):
    return body.main_lines(md, title, url, scores, variety or {}, headings or {})


def key(line):
    return body.read_line(line)[0]


def test_paths():
    def steps(line):
        leaf = body.read_line(line)
        return leaf.block, leaf.wrapping, leaf.kind

    assert steps("## Open questions") == (body.HEADING, body.BARE, body.LABEL)
    assert steps("- [Home](/h)") == (body.LIST, body.LINKED, body.LABEL) and body.read_line("[Home](/h)").chars == 0
    assert steps("> " + P) == (body.QUOTE, body.BARE, body.SENTENCE)
    assert steps("| a | 1 |") == (body.TABLE, body.BARE, body.CELLS) and steps("Terms | Privacy")[2] == body.LABEL
    assert steps("Anna 12: " + P) == (body.PARAGRAPH, body.NAMED, body.SENTENCE)
    assert steps("*Some One – The Paper*") == (body.PARAGRAPH, body.EMPHASIS, body.LABEL)
    assert steps("He was [asked](https://a.test/1) about the [quay.](https://a.test/2)")[2] == body.SENTENCE
    assert body.read_line("  \t") is None and key("**12 Shares**") == key("- 7 shares")
    runs = [p // 15 % 2 for _, p, _ in body.read_page("one\n\ntwo\nthree\n", None, None)]
    assert runs == [1, 0, 0]


def test_headline():
    assert [p // 3 % 5 == body.TITLED for _, p, _ in body.read_page("World > The quay\n# The Quay!\nThe quay", "the quay", None)] == [False, True, False]
    assert [p // 3 % 5 == body.TITLED for _, p, _ in body.read_page("Menu\nThe quay opens today in town", None, "https://a.test/n/the-quay-opens-12?x=1")] == [False, True]


def test_dense_stretch():
    nodes = body.read_page("\n".join(["Home", "News", P, P, "Print", P, P, "Read next", "[A](/a)", "[B](/b)", "Ann 1: " + P]), None, None)
    assert body.dense_stretch(nodes) == (2, 6)
    assert body.dense_stretch(body.read_page("Home\nNews", None, None)) == (0, -1)


def test_scores_decide():
    md = "\n".join(["Home", "[World](/w) [Sport](/s)", "", "# The quay", P, "", "By Some One", P, "## Background", "- " + P, "> " + P, "| a | 1 |", "Anna 12: " + P, "*Some One – The Paper*", "## Read next", "- [Another story](/x)"])
    assert lines_of(md, "The quay") == [3, 4, 7, 8, 9, 10, 11]
    assert lines_of(md, "The quay", scores={}) == []
    list_path = body.path_number(body.LIST, False, body.BARE, body.SENTENCE)
    assert 9 not in lines_of(md, "The quay", scores={**SCORES, list_path: (1.0, 0.0)})


def test_templates_and_headings():
    md = "\n".join(["# The quay", P, "This story is free for readers.", "Reaction", P, "Related", "The mine reopens", P])
    headings = {key("reaction"): True, key("RELATED"): False}
    assert lines_of(md, "The quay", variety={key("This story is free for readers."): 0.0}, headings=headings) == [0, 1, 3, 4, 7]


def test_no_article():
    assert lines_of("Access denied.\n\nTry again later.") == []
    assert lines_of("Home\n\n## Most read\n- [One](/1)\n- [Two](/2)", "Front") == []
    assert lines_of("") == [] and lines_of("\n \n", "x", "y") == []
    assert lines_of("The harbour opens. It is late.", "The harbour opens") == [0]


def pages_of(n):
    return [(i, f"https://a.test/story-{i}", f"Story {chr(65 + i)} about the harbour", f"Menu\n[Home](/h)\n\n# Story {chr(65 + i)} about the harbour\n{P} It is number {chr(97 + i)}.\n\n{P} Again {chr(97 + i)}.\n\nPaid for by readers of this paper.\n" + "**Print**") for i in range(n)]


SCHEMA = "crawl_id long, url string, title string, markdown string, site string, lines int"


def test_operator(spark):
    rows = [*pages_of(20), (90, None, None, None), (91, "https://a.test/e", "x", ""), (92, "https://a.test/f", None, "Error 404"), (93, None, None, " \n"), (5, *pages_of(6)[5][1:])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = sorted((r.page_id, r.lines) for r in body.main_content(df).collect())
    assert got == sorted([*((i, [3, 4, 6]) for i in range(20)), (5, [3, 4, 6]), (92, []), (93, [])])
    assert body.main_content(df.limit(0)).count() == 0


def test_ratios_are_smoothed_towards_the_parent(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in pages_of(20)] + [(70, "https://b.test/one", None, f"> {P}\n\nInfo", "clash", 1), (71, "https://a.test/q", None, f"> {P}\n\nInfo", "clash", 1)], SCHEMA)
    sums = body.path_sums(df).cache()
    assert sums.where("path % 3 = 1").agg({"inside": "sum"}).first()[0] == 62
    totals = spark.createDataFrame([("a.test", 21), ("b.test", 1)], "site string, pages_of_site long")
    repeated = {r.key: r.variety for r in body.repeated_templates(sums, totals).collect()}
    assert repeated[key("Paid for by readers of this paper.")] == 0.0 and key(P) not in repeated
    frame = spark.createDataFrame(list(repeated.items()), "key long, variety double").selectExpr("'a.test' as site", "key", "variety")
    scores = {(r.site, r.path): r.score for r in body.path_scores(sums.join(frame, ["site", "key"], "left")).collect()}
    quote = body.path_number(body.QUOTE, True, body.BARE, body.SENTENCE)
    assert scores["b.test", quote] == pytest.approx(scores["a.test", quote])  # both at the parent's ratio
    sentence = body.path_number(body.PARAGRAPH, False, body.BARE, body.SENTENCE)
    assert scores["a.test", sentence] > body.THRESHOLD
