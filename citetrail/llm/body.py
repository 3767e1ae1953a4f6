"""The main body of web pages (problem 2), by tag-path ratios.

A line of a page is a leaf, and its path from the root is: site, block (heading, list, quote, table or paragraph), run
(alone between blank lines or not), wrapping (none, emphasis around all, a link around all, a name before a colon, the
page's own title) and kind of text (label, sentence, cells). Where a site repeats a line, the line's template (numbers as
0) is one more step of the path.

Text length, punctuation and the part of its lines that lie in the densest stretch of their pages are summed per path over
all pages, smoothed towards the parent path (the same without run and wrapping, and that over all sites), and fused to one
score; a repeated template scores the less the more of its site's pages have it. A heading's path is scored by the text
of the section it opens. Paths from a threshold are content, and every line kept stands on one of them; a page whose kept
lines hold little text has no article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citetrail.llm.lines import page_site
from citetrail.runtime import BROADCAST_ROWS, join_sized, materialise

#: Lines that the parent path weighs when a path's ratios are smoothed, and when a heading's are.
SMOOTHING, HEADING_SMOOTHING = 200.0, 4.0
#: Fused score from which a path of text is content: log text length x punctuation x cubed part in the dense stretch.
THRESHOLD = 2.0
#: Part of a site's pages at which a template tells nothing of its page any more, and from which it is a step of the path.
COMMON_SHARE, TEMPLATE_SHARE = 0.2, 0.02
#: Score from which a heading's path is content: part of sections that open with text x how surely the line is a heading.
HEADING_THRESHOLD = 0.4
#: Part of a label's lines marked as a heading from which it surely is one.
HEADED_SHARE = 0.1
#: Part of all pages from which a heading's template is a path of its own; so at most (lines per page) / HEADING_SHARE are.
HEADING_SHARE = 0.0004
#: Text, in characters, of the least article without a headline.
PAGE_CHARS = 250
#: Weights of text, labels and links when the densest stretch of a page is found.
STRETCH = (1.0, -1.0, -1.0)

# Signs that end a sentence, signs that may follow them, and signs counted as punctuation.
_ENDS = frozenset(".!?…。！？।")
_AFTER_END = frozenset("\"”“’»›)]」』")
_SIGNS_OF_TEXT = re.compile(r"[.,;:!?…。！？।、，“”„«»|]")
_LINK = re.compile(r"!?\[([^\]]*)\]\([^)\s]*\)")
_SIGNS = re.compile(r"^[\s#>*+_-]+")
_NAMED = re.compile(r"[^\W\d_][\w’'.-]{0,30}(?: \d{1,4})?: ")
_WORDS = re.compile(r"[^\W_]+")
_LIST_NUMBER = re.compile(r"[*+>#-]*\s*\d{1,9}[.)](?=\s)")
_DIGITS = re.compile(r"\d+")

# Steps of a path, each a digit of its number: block, wrapping, kind of text.
PARAGRAPH, HEADING, LIST, QUOTE, TABLE = range(5)
BARE, EMPHASIS, LINKED, NAMED, TITLED = range(5)
LABEL, SENTENCE, CELLS = range(3)
#: Longest label that may be a heading, in characters.
LABEL_CHARS = 80
#: Lines met lately, with what is known of them: most lines of a site stand on many of its pages.
_MEMO: dict[str, tuple | None] = {}
MEMO, MEMO_CHARS = 20_000, 400


class Leaf(tuple):
    """key, chars, signs, block, wrapping, kind, plain: a line as a leaf. key is a 64-bit number of its template, plain its text without signs and addresses."""

    __slots__ = ()
    key, chars, signs, block, wrapping, kind, plain = (property(lambda s, i=i: s[i]) for i in range(7))


def read_line(line: str) -> Leaf | None:
    """A line as a leaf; None: blank.

    The template is the line without letter case, spacing, signs of emphasis, heading, list or quote, and with every
    number as 0, as in `lines.line_keys`. Text within links is no text of a line that is links only.
    """
    try:
        return _MEMO[line]
    except KeyError:
        pass
    s = line.strip()
    got = _read(s) if s else None
    if len(line) <= MEMO_CHARS:
        if len(_MEMO) > MEMO:
            _MEMO.clear()
        _MEMO[line] = got
    return got


def _read(s: str) -> Leaf:
    t = s.lower()
    numbered = (t[0] in "*+>#-" or t[0].isdigit()) and _LIST_NUMBER.match(t)
    if numbered:
        t = t[numbered.end() :]
    t = "".join(t.split()).replace("*", "").replace("_", "")
    bare = t.lstrip(">+-")
    t = _DIGITS.sub("0", t.lstrip("#>+-") or t)
    links = "](" in s
    plain = _SIGNS.sub("", _LINK.sub(r"\1", s) if links else s).rstrip("*_ ")
    only = links and not _WORDS.search(_LINK.sub("", s))
    cells = s[0] == "|" and s.count("|") > 2
    closed = plain[-1:] in _ENDS or (plain[-2:-1] in _ENDS and plain[-1:] in _AFTER_END)
    block = HEADING if bare.startswith("#") else TABLE if s[0] == "|" else QUOTE if s[0] == ">" else LIST if numbered or s[:2] in ("- ", "* ", "+ ") else PARAGRAPH
    wrapping = LINKED if only else NAMED if _NAMED.match(plain) else EMPHASIS if s[0] in "*_" and s[-1] in "*_" else BARE
    kind = CELLS if cells else SENTENCE if closed else LABEL
    return Leaf((xxhash.xxh3_64_intdigest(t) - (1 << 63), 0 if only else len(plain), 0 if only else len(_SIGNS_OF_TEXT.findall(plain)), block, wrapping, kind, plain))


def read_page(markdown: str, title: str | None, url: str | None) -> list[tuple[int, int, Leaf]]:
    """(line number, path, leaf) of every line that is not blank; the first line that is the page's title, or starts as its address ends, is wrapped as titled."""
    info: list[list] = []
    after_blank = True
    for i, line in enumerate(markdown.split("\n")):
        leaf = read_line(line)
        if leaf is None:
            after_blank = True
            if info:
                info[-1][3] = True
            continue
        info.append([i, leaf, after_blank, False])
        after_blank = False
    if info:
        info[-1][3] = True
    headline = _headline(info, title, url)
    return [(i, path_number(leaf[3], alone and last, TITLED if k == headline else leaf[4], leaf[5]), leaf) for k, (i, leaf, alone, last) in enumerate(info)]


def _headline(info: list[list], title: str | None, url: str | None) -> int | None:
    wanted = "".join(_WORDS.findall((title or "").lower()))
    slug = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"[?#].*", "", url or "").rstrip("/").rpartition("/")[2].lower()) if w]
    if slug and slug[-1].isdigit():
        slug.pop()
    slug_text = "-".join(slug) if sum(map(len, slug)) >= 12 else ""
    most = 8 + len(wanted) * 5 // 4
    for k, (_, leaf, _, _) in enumerate(info):
        plain = leaf[6]
        if leaf[5] == CELLS or leaf[4] == LINKED or not 3 <= len(plain) < 200:
            continue
        low = plain.lower()
        if wanted and len(low) <= most * 2 and "".join(_WORDS.findall(low)) == wanted:
            return k
        if slug_text and leaf[5] == LABEL and "-".join(w for w in re.split(r"[^a-z0-9]+", low) if w).startswith(slug_text):
            return k
    return None


def _opens_with(markdown: str, line_no: int, title: str | None) -> bool:
    """Whether a line starts with the page's title: a page that is one line."""
    wanted = "".join(_WORDS.findall((title or "").lower()))
    return len(wanted) >= 12 and "".join(_WORDS.findall(markdown.split("\n", line_no + 1)[line_no].lower())).startswith(wanted)


def path_number(block: int, alone: bool, wrapping: int, kind: int) -> int:
    return ((block * 2 + alone) * 5 + wrapping) * 3 + kind


def dense_stretch(nodes: list[tuple[int, int, Leaf]]) -> tuple[int, int]:
    """First and last place of the stretch of a page with the most text and the fewest labels and links, from the page's title on if that stands above it."""
    text, label, link = STRETCH
    best, begin, finish, total, start, titled = 0.0, 0, -1, 0.0, 0, None
    for k, (_, path, leaf) in enumerate(nodes):
        if path // 3 % 5 == TITLED:
            titled = k
        if total <= 0:
            total, start = 0.0, k
        total += link if leaf[4] == LINKED else label if leaf[5] == LABEL else text
        if total > best:
            best, begin, finish = total, start, k
    return (begin if titled is None or titled > begin else titled), finish


_SUMS = ("lines", "chars", "signs", "inside", "headed", "below")


def path_sums(pages: DataFrame, text: str = "markdown", url: str = "url", title: str = "title") -> DataFrame:
    """site, path, key, lines, chars, signs, inside, headed, below: per path and template of a site the sums that ratios are made of.

    signs counts three punctuation signs a line at most, inside lines in the densest stretch of their page, headed labels
    marked as a heading, below labels whose next line is text; of a titled line below tells whether text comes before
    the next link or heading. Sums are made per task before rows move.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int, int], list[int]] = {}

        def flush() -> pd.DataFrame:
            rows = [(*k, *v) for k, v in sums.items()]
            sums.clear()
            return pd.DataFrame(rows, columns=["site", "path", "key", *_SUMS])

        for pdf in batches:
            for site, t, title_, url_ in zip(pdf["site"], pdf["text"], pdf["title"], pdf["url"], strict=True):
                nodes = read_page(t, title_, url_)
                begin, finish = dense_stretch(nodes)
                below = section = 0
                for k in range(len(nodes) - 1, -1, -1):
                    _, path, leaf = nodes[k]
                    key, chars, signs, block, wrapping, kind, _ = leaf
                    got = sums.get((site, path, key))
                    if got is None:
                        got = sums[site, path, key] = [0, 0, 0, 0, 0, 0]
                    got[0] += 1
                    got[1] += chars
                    got[2] += signs if signs < 3 else 3
                    got[3] += begin <= k <= finish
                    if kind == LABEL:
                        got[4] += block == HEADING
                        got[5] += section if path // 3 % 5 == TITLED else below
                    below = int(kind != LABEL and wrapping != LINKED)
                    section = below or (section if wrapping != LINKED and block != HEADING else 0)
            if len(sums) > 100_000:
                yield flush()
        yield flush()

    site_of = F.coalesce(page_site(url), F.lit(""))
    base = pages.where(F.col(text) != "").select(site_of.alias("site"), F.col(text).alias("text"), F.col(title).alias("title"), F.col(url).alias("url"))
    rows = base.mapInPandas(count, "site string, path int, key long, " + ", ".join(f"{c} long" for c in _SUMS))
    # Placed by site and template, which serves both the sums per path and template and those per template.
    return rows.repartition("site", "key").groupBy("site", "key", "path").agg(*(F.sum(c).alias(c) for c in _SUMS))


def smoothed(total: Column, lines: Column, parent: Column, weight: float = SMOOTHING) -> Column:
    """A ratio per line, as if so many lines more had the ratio of the parent path."""
    return (total + weight * parent) / (lines + weight)


def path_scores(sums: DataFrame) -> DataFrame:
    """site, path, score, opens: the fused score of every path, and the smoothed part of its lines that stand right above text.

    Ratios are smoothed towards those of the parent path: block, wrapping and kind, without site and run. Lines of
    repeated templates, paths of their own, weigh by their variety.
    """
    ratios = ("chars", "signs", "inside", "below")
    weight = F.coalesce("variety", F.lit(1.0))
    step = F.concat_ws(".", F.expr("path div 30"), F.expr("path % 15"))
    t = sums.groupBy("site", "path").agg(*(F.sum(F.col(c) * weight).alias(c) for c in _SUMS)).withColumn("step", step)
    parents = t.groupBy("step").agg(*((F.sum(c) / F.greatest(F.sum("lines"), F.lit(1.0))).alias(f"parent_{c}") for c in ratios))
    # One row per block, wrapping and kind, 75 at most.
    t = t.join(F.broadcast(parents), "step").select("site", "path", *(smoothed(F.col(c), F.col("lines"), F.col(f"parent_{c}")).alias(c) for c in ratios))
    return t.select("site", "path", fused_score(F.col("chars"), F.col("signs"), F.col("inside")).alias("score"), F.col("below").alias("opens"))


def fused_score(chars: Column, signs: Column, inside: Column) -> Column:
    """log text length x punctuation signs a line, 1 at most x part of lines in the densest stretch, to the third power."""
    return F.log1p(chars) * F.least(signs, F.lit(1.0)) * F.pow(inside, F.lit(3.0))


def repeated_templates(sums: DataFrame, totals: DataFrame) -> DataFrame:
    """site, key, variety: templates that are a step of the path, and what their score is multiplied by: 1 - (share of pages / COMMON_SHARE) squared, at least 0.

    The share is taken at its lower bound of one standard error, so a few chance repeats on a small site do not count.
    A site has at most (lines per page) / TEMPLATE_SHARE of them.
    """
    share = (F.col("lines") - F.sqrt("lines")) / F.col("pages_of_site")
    t = sums.groupBy("site", "key").agg(F.sum("lines").alias("lines")).where("lines > 2").join(totals, "site").where(share >= TEMPLATE_SHARE)
    return t.select("site", "key", (1 - F.pow(F.least(share / COMMON_SHARE, F.lit(1.0)), F.lit(2.0))).alias("variety"))


def heading_templates(sums: DataFrame, n_pages: int) -> DataFrame:
    """key, content: labels that are headings on enough pages, and whether their path is content.

    The score is the part of their sections that open with text, smoothed towards the part over all headings, times
    the part marked as a heading over HEADED_SHARE, 1 at most.
    """
    t = sums.where(f"path % 3 = {LABEL} and path div 3 % 5 <> {TITLED} and chars <= lines * {LABEL_CHARS}")
    t = t.groupBy("key").agg(F.sum("lines").alias("n"), F.sum("headed").alias("headed"), F.sum("below").alias("below"))
    t = materialise(t.where((F.col("headed") > 0) & (F.col("n") >= max(3.0, HEADING_SHARE * n_pages))))
    parent = t.agg(F.sum("below") / F.sum("n")).first()[0] or 0.0
    score = smoothed(F.col("below"), F.col("n"), F.lit(parent), HEADING_SMOOTHING) * F.least(F.lit(1.0), F.col("headed") / F.col("n") / HEADED_SHARE)
    return t.select("key", (score >= HEADING_THRESHOLD).alias("content"))


def main_lines(markdown: str, title: str | None, url: str | None, scores: dict[int, tuple[float, float]], variety: dict[int, float], headings: dict[int, bool]) -> list[int]:
    """Numbers of the lines that belong to the article.

    Given are score and part above text by path, what repeated templates of the site are multiplied by, and of the labels
    that are headings whether their path is content.
    """
    keep: list[int] = []
    pending: list[int] = []
    size, headline = 0, None
    for i, path, leaf in read_page(markdown, title, url):
        key, chars, _, block, wrapping, kind, _ = leaf
        score, opens = scores.get(path, (0.0, 0.0))
        if path // 3 % 5 == TITLED:
            if opens + score >= HEADING_THRESHOLD:
                headline = i
        elif score * variety.get(key, 1.0) >= THRESHOLD:
            keep += pending
            pending = []
            keep.append(i)
            size += chars
        elif kind == LABEL and wrapping != LINKED and chars <= LABEL_CHARS:
            content = headings.get(key)
            if content if content is not None else block == HEADING and opens >= HEADING_THRESHOLD and key not in variety:
                pending.append(i)
            elif content is not None or block == HEADING:
                pending = []
        else:
            pending = []
    if not keep or (headline is None and size < PAGE_CHARS and not _opens_with(markdown, keep[0], title)):
        return []
    return sorted(keep if headline is None else [headline, *keep])


def main_content(pages: DataFrame, page_id: str = "crawl_id", text: str = "markdown", url: str = "url", title: str = "title") -> DataFrame:
    """page_id, lines array<int>: for every page with a text the numbers of the lines that belong to its article, counted from 0 with blank lines.

    Error pages, pages without an article, and blank texts have an empty array; null and empty texts have no row. A null
    title or url only takes away a way to find the headline; pages without a host are one site. Repeated rows give
    repeated rows. An empty table gives no rows. Columns other than the four named are not read.
    """
    some = pages.where(F.col(text) != "")
    sums = materialise(path_sums(some, text, url, title))
    site_of = F.coalesce(page_site(url), F.lit(""))
    totals = materialise(some.groupBy(site_of.alias("site")).agg(F.count(F.lit(1)).alias("pages_of_site")))
    n_pages = totals.agg(F.sum("pages_of_site")).first()[0] or 0
    headings = {r.key: r.content for r in heading_templates(sums, n_pages).collect()}
    repeated = materialise(repeated_templates(sums, totals))
    paths = path_scores(join_sized(sums, repeated, ["site", "key"], "left")).groupBy("site").agg(F.collect_list(F.struct("path", "score", "opens")).alias("paths"))
    templates = repeated.groupBy("site").agg(F.collect_list(F.struct("key", "variety")).alias("templates"))
    of_site = materialise(paths.join(templates, "site", "left"))
    n_sites = of_site.count()
    base = some.select(F.col(page_id).alias("page_id"), F.col(text).alias("text"), F.col(title).alias("title"), F.col(url).alias("url"), site_of.alias("site"))
    # One row per site: broadcast while few, else a join whose hot sites AQE splits.
    joined = base.join(F.broadcast(of_site) if n_sites <= BROADCAST_ROWS // 100 else of_site.hint("merge"), "site", "left")

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[dict, dict]] = {}
        for pdf in batches:
            found = []
            for t, title_, url_, site, paths_, templates_ in zip(pdf["text"], pdf["title"], pdf["url"], pdf["site"], pdf["paths"], pdf["templates"], strict=True):
                got = known.get(site)
                if got is None:
                    if len(known) > 1_000:
                        known.clear()
                    got = known[site] = (
                        {} if paths_ is None else {p["path"]: (p["score"], p["opens"]) for p in paths_},
                        {} if templates_ is None else {p["key"]: p["variety"] for p in templates_},
                    )
                found.append(main_lines(t, title_, url_, *got, headings))
            yield pd.DataFrame({"page_id": pdf["page_id"], "lines": found})

    kind = dict(base.dtypes)["page_id"]
    return joined.select("page_id", "text", "title", "url", "site", "paths", "templates").mapInPandas(select, f"page_id {kind}, lines array<int>")
