"""Sentence units of texts in any script (problem 10), by a hidden-event language model.

Boundary tokens are hidden events between words. A first pass over all texts counts what is certain (block ends and
block starts) and what is open (words on both sides of a possible boundary). A word that ends sentences ends blocks in a
steady proportion, so the certain ends give P(boundary | word before), the certain starts P(word after | boundary), and
what they leave unexplained P(word after | word before, none); a few rounds of expectation maximisation settle the
starts. A second pass decides each place by its posterior, with forward-backward over a block. In scripts that have
neither terminators nor spaces between words (Thai, Lao) the same model runs over characters, every one of them a place,
with spaces as the certain boundaries. In other scripts only signs, quotes and brackets are places.
"""

from __future__ import annotations

import gc
import math
import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetrail.runtime import materialise

#: Words rarer than this part of all places share one type by their form, so the model's size is bounded whatever the corpus.
MIN_SHARE = 2e-5
#: Pairs of words rarer than this part of all places count for the form of their first word; so at most 1 / PAIR_SHARE pairs, and as many rows of forms as there are types, reach the driver.
PAIR_SHARE = 2e-6
#: Contexts of characters rarer than this part of all pieces are not told apart from those at it.
SIDE_SHARE, INNER_SHARE = 1e-4, 1e-5
#: Rounds of expectation maximisation.
ROUNDS = 3
#: Characters on each side of a place in a script without terminators.
SIDE = 6
#: Blocks whose places are kept at hand.
MEMO = 100_000
#: Part of the boundaries in such a script at which the space is missing.
RUN_ON = 0.03

# Terminators by kind, and pairs of quotes and brackets.
FULL_STOPS = "。！？．।॥۔؟።፧។៕၊။"
_SPAN = r"„[^“”„]*[“”]|“[^”“]*”|«[^»«]*»|「[^」「]*」|『[^』『]*』|\"[^\"]*\"|\([^()]*(?:\([^()]*\)[^()]*)*\)|（[^（）]*）|\[[^\[\]]*\]"
_PAIR = re.compile(_SPAN)
_OPENERS = "„“«「『\"(（["
# Signs are found one character at a time, which is fast; what they begin is matched only there.
_EVENT = re.compile(rf"[„“«「『\"(（\[!?…{FULL_STOPS}]|\.(?!\d)")
_EVENT_THAI = re.compile(_EVENT.pattern + r"|(?<=\S)\s+(?=\S)")
_RUN = re.compile(rf"(?:[!?…]|\.(?!\d)|[{FULL_STOPS}])+[’'”»›)\]】」』]*")
_THAI = re.compile(r"[\u0e00-\u0eff]")  # Thai and Lao
_TOKEN = re.compile(r"\S+")
_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_CLAIM = re.compile(r"(\d+)[.．](?=\s)")
_NEXT_CLAIM = re.compile(r"\n[^\S\n]*(\d+)[.．](?=\s)")
_THAI_NUMBER = re.compile(r"(?:\[\d+\]|\(\d+\)|\d+[.)．])\Z")
_AFTER = re.compile(r"[¿¡\"“„«「『(\[（]*(?:([^\W\d_]+)|(\d)|\S)")
_LAST = re.compile(r"[^\W\d_]*[.!?…]+$")
_NUMBERED = re.compile(r"\[\d+\]\s*")
_DIGITS = re.compile(r"\d+")
_CLOSERS = "’'\"”“»›)]】」』）"
_CLOSERS_OR_SPACE = frozenset(_CLOSERS + " ")
_ENDINGS = frozenset(".!?…" + FULL_STOPS)
_FULL = frozenset(FULL_STOPS)
_BEGINS = frozenset("¿¡“„«「『（【\"([")
_PLAIN_GAP = frozenset(" \n")
_GOES_ON = frozenset("!?.,;:)" + FULL_STOPS)
_OFFSET_CLOSERS = frozenset([" »", " )", "\u00a0»", "\u202f»"])


#: Types of words met lately; words repeat far more often than they are new.
_BEFORE: dict[str, str] = {}
_AFTERS: dict[str, tuple[str, str]] = {}


def _key_before(text: str, lo: int, at: int) -> str:
    """The type of the word that ends at `at`."""
    last = text[at - 1]
    if last in ".!?":
        word = text[max(lo, at - 24, text.rfind(" ", lo, at) + 1) : at]
        if "\n" in word:
            word = word[word.rfind("\n") + 1 :]
        got = _BEFORE.get(word)
        if got is None:
            if len(_BEFORE) > 100_000:
                _BEFORE.clear()
            got = _BEFORE[word] = _typed(word)
        return got
    if last in FULL_STOPS:
        return last
    if last in _CLOSERS:
        k = at - 1
        while k > lo and text[k - 1] in _CLOSERS_OR_SPACE:
            k -= 1
        return (text[k - 1] if text[k - 1] in _ENDINGS else "") + last
    return _typed(text[max(lo, at - 24, text.rfind(" ", lo, at) + 1, text.rfind("\n", lo, at) + 1) : at])


def _typed(word: str) -> str:
    """The type of a word with the signs at its end."""
    m = _LAST.search(word)
    tail = m[0] if m else word[-1:]
    if tail in (".", "!", "?", "...", "…") and m and m.start():
        before = word[m.start() - 1]
        return ("9" if before.isdigit() else before) + tail
    if "." in word[: -len(tail)] and len(tail) <= 3:
        return _DIGITS.sub("9", word.lstrip("(["))[-8:].lower()
    return tail.lower()


def _key_after(text: str, at: int, hi: int) -> tuple[str, str]:
    """The type of the word that starts at `at`, and its form: upper, lower, digit or other."""
    m = _AFTER.match(text, at, hi)
    if m is None:
        return "", "o"
    if m[2]:
        return "9", "d"
    word = m[1]
    if not word:
        return m[0][-1], "o"
    first = word[0]
    if first >= "\u2e80":
        return word[:3], "o"
    if first >= "\u0e00":
        return word[:4], "o"
    return word[:14].lower(), "U" if first.isupper() else "l" if first.islower() else "o"


@contextmanager
def _no_cycle_collection() -> Iterator[None]:
    """Nothing here makes cycles, while the many small tuples would set off collections again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@dataclass
class Block:
    """Text between blank lines: a claim list (its cuts are known) or a paragraph with places where a sentence may end."""

    start: int
    end: int
    cuts: list[int] | None = None
    thai: bool = False
    places: list[tuple[int, int, str, str, str]] = field(default_factory=list)  # end of unit, next start, before, after, form
    fixed: list[tuple[int, int]] = field(default_factory=list)  # certain boundaries: end of unit, next start


def block_spans(text: str) -> Iterator[tuple[int, str]]:
    """Start and text of what stands between blank lines, without white space around."""
    lo = 0
    for at, end in [*(m.span() for m in _BLANK.finditer(text)), (len(text), len(text))]:
        block = text[lo:at]
        if block[:1].isspace():
            lo += len(block) - len(block.lstrip())
            block = block.lstrip()
        if block[-1:].isspace():
            block = block.rstrip()
        if block:
            yield lo, block
        lo = end


def scan(text: str) -> Block:
    """The places of one block."""
    lo, hi = 0, len(text)
    b = Block(lo, hi)
    claim = _CLAIM.match(text, lo, hi)
    if claim:
        number, b.cuts = int(claim[1]), []
        for c in _NEXT_CLAIM.finditer(text, lo, hi):
            if int(c[1]) == number + 1:
                number += 1
                b.cuts.append(c.start(1))
        return b
    # A block is in the script without terminators when that has at least a third of its letters.
    b.thai = not text.isascii() and _THAI.search(text, lo, hi) is not None and 3 * len(_THAI.findall(text, lo, hi)) >= sum(map(str.isalpha, text[lo:hi]))
    word = past = lo
    for e in (_EVENT_THAI if b.thai else _EVENT).finditer(text, lo, hi):
        first = e.start()
        if first < past:
            continue
        sign = text[first]
        if sign.isspace():
            cut, at = first, e.end()
            after = _TOKEN.match(text, at, hi)[0]
            if (_THAI.search(text, word, cut) or _THAI.search(after)) and not _THAI_NUMBER.match(text[word:cut]):
                b.fixed.append((cut, at))
            word = at
            continue
        run = None
        if sign in _OPENERS:
            pair = _PAIR.match(text, first, hi)
            if pair is None:
                continue
            past = at = pair.end()
            k = at - 1
            while k > first and text[k - 1] in _CLOSERS_OR_SPACE:
                k -= 1
            if text[k - 1] not in _ENDINGS:
                continue
        else:
            run = _RUN.match(text, first, hi)
            past = at = run.end()
            # A closing sign set off by a space, as in French quotes, belongs to what it closes.
            if text[at : at + 2] in _OFFSET_CLOSERS:
                continue
        nxt = at + 1 if text[at : at + 1] == " " else at
        while nxt < hi and text[nxt].isspace():
            nxt += 1
        if nxt >= hi:
            continue
        if run is not None and (sign in _FULL or at > first + 1 and run[0].rstrip(_CLOSERS)[-1] in _FULL):
            if not (run[0] == "．" and text[first - 1].isdigit() and text[at].isdigit()):
                b.fixed.append((at, nxt))
            continue
        gap = nxt > at
        if not gap and not (text[nxt].isalpha() or text[nxt] in _BEGINS) and text[at - 1] not in _FULL:
            continue
        if not gap and text[nxt] in _GOES_ON:
            continue
        end = text.find(" ", nxt, nxt + 24)
        word_after = text[nxt:end] if end > 0 else text[nxt : nxt + 24]
        got = _AFTERS.get(word_after)
        if got is None:
            if len(_AFTERS) > 100_000:
                _AFTERS.clear()
            got = _AFTERS[word_after] = _key_after(word_after, 0, len(word_after))
        after, form = got
        b.places.append((at, nxt, _key_before(text, lo, at), after, form if gap else form + "0"))
    return b


def _thai_pieces(b: Block) -> Iterator[tuple[int, int]]:
    """Spans between certain boundaries of a block in the script without terminators."""
    lo = b.start
    for cut, nxt in [*b.fixed, (b.end, b.end)]:
        yield lo, cut
        lo = nxt


def events(text: str) -> list[tuple[str, str, str, str]]:
    """What one block says: ends E, starts S, open places C; in a script without terminators ends e, starts s, inner places i."""
    b, out = scan(text), []
    if b.cuts is not None:
        return [("E", _key_before(text, 0, b.end), "", "")]
    if b.thai:
        for lo, hi in _thai_pieces(b):
            piece = _DIGITS.sub("9", _NUMBERED.sub("", text[lo:hi], count=1) if text[lo] == "[" else text[lo:hi])
            if len(piece) < 2 * SIDE:
                continue
            out.append(("s", piece[:SIDE], "", ""))
            out.append(("e", piece[-SIDE:], "", ""))
            out.extend(("i", piece[k - SIDE : k], piece[k : k + SIDE], "") for k in range(SIDE, len(piece) - SIDE + 1))
    if text[-1] in _ENDINGS or text[-1] in _CLOSERS:
        out.append(("E", _key_before(text, 0, b.end), "", ""))
        m = _NUMBERED.match(text)
        after, form = _key_after(text, m.end() if m else 0, b.end)
        out.append(("S", after, form, ""))
    out.extend(("C", before, after, form) for _, _, before, after, form in b.places)
    return out


def count_events(text: str, out: Counter, memo: dict[str, list]) -> None:
    """Adds the events of a text's blocks; `memo` keeps those of blocks met lately, which copies and families repeat."""
    for _, block in block_spans(text):
        found = memo.get(block)
        if found is None:
            if len(memo) > MEMO:
                memo.clear()
            found = memo[block] = events(block)
        for k in found:
            out[k] += 1


def _shape_before(key: str) -> str:
    core = key.rstrip(".!?…")
    return f"<{min(len(core), 5)}{key[len(core):][:1]}>"


def _shape_after(key: str, form: str) -> str:
    return f"<{form[:1]}{'1' if len(key) == 1 else ''}>"


@dataclass
class Model:
    """Probabilities of the hidden events by types; thai_*: by the characters on both sides."""

    before: dict[str, tuple[float, float]] = field(default_factory=dict)  # open places with and without a boundary
    after: dict[str, tuple[float, float]] = field(default_factory=dict)  # P(word | boundary), P(word | none)
    pair: dict[tuple[str, str], float] = field(default_factory=dict)  # P(word after | word before, none)
    form: dict[str, tuple[float, float]] = field(default_factory=dict)
    thai_end: dict[str, float] = field(default_factory=dict)
    thai_start: dict[str, float] = field(default_factory=dict)
    thai_inner: dict[str, float] = field(default_factory=dict)
    thai_n: float = 1.0
    thai_rare: float = 0.0
    memo: dict = field(default_factory=dict)
    blocks: dict[str, list] = field(default_factory=dict)  # cuts of blocks met lately

    def odds(self, before: str, after: str, form: str) -> float:
        """Log odds of a boundary between two words."""
        key = (before, after, form)
        got = self.memo.get(key)
        if got is None:
            p = before if before in self.before else _shape_before(before)
            a = after if after in self.after else _shape_after(after, form)
            yes, no = self.before.get(p, (0.5, 0.5))
            start, other = self.after.get(a, (1e-5, 1e-5))
            fb, fn = self.form.get(form, (0.5, 0.5))
            got = math.log(yes * start * fb + 1e-12) - math.log(no * (0.9 * self.pair.get((p, a), 0.0) + 0.1 * other) * fn + 1e-12)
            if len(self.memo) < 1_000_000:
                self.memo[key] = got
        return got


def fit(counts: dict[tuple[str, str, str, str], int]) -> Model:
    """The model from the counts of the whole corpus."""
    ends, starts, open_, total = Counter(), Counter(), Counter(), 0
    for (kind, a, b, c), n in counts.items():
        if kind == "C":
            open_[a, b, c] += n
        elif kind == "E":
            ends[a] += n
        elif kind == "S":
            starts[a, b] += n
        total += n if kind in "CES" else 0
    least = max(2.0, MIN_SHARE * total)
    n_before, n_after = Counter(ends), Counter()
    for (a, b, _), n in open_.items():
        n_before[a] += n
        n_after[b] += n
    for (a, _), n in starts.items():
        n_after[a] += n
    places, e, s = Counter(), Counter(), Counter()
    for (a, b, c), n in open_.items():
        places[a if n_before[a] >= least else _shape_before(a), b if n_after[b] >= least else _shape_after(b, c), c] += n
    for a, n in ends.items():
        e[a if n_before[a] >= least else _shape_before(a)] += n
    for (a, f), n in starts.items():
        s[a if n_after[a] >= least else _shape_after(a, f)] += n
    return _fit(places, e, s, Counter(), *_sides(counts))


def _sides(counts: dict[tuple[str, str, str, str], int]) -> tuple[Counter, Counter, Counter]:
    out = {"e": Counter(), "s": Counter(), "i": Counter()}
    for (kind, a, b, _), n in counts.items():
        if kind in out:
            out[kind][a + b] += n
    return out["e"], out["s"], out["i"]


def _fit(places: Counter, e: Counter, s: Counter, sums: Counter, te: Counter, ts: Counter, ti: Counter) -> Model:
    """The model from counts by type: places (before, after, form), ends, starts; ends, starts and inner contexts in characters.

    sums: places by (before, form), where rare pairs in `places` have only the form of their first word; else empty.
    """
    if not sums:
        for (p, _, f), n in places.items():
            sums[p, f] += n
    c_p, c_a = Counter(), Counter()
    for (p, _), n in sums.items():
        c_p[p] += n
    for (p, a, _), n in places.items():
        c_p[p] += 0
        c_a[a] += n
    # Open places per certain end, of words that end sentences; words that also stand inside sentences lie above it.
    ratios = sorted(c_p[p] / n for p, n in e.items() if n >= max(5.0, 1e-4 * sum(e.values())) and c_p[p])
    per_end = 1.5 * ratios[int(0.9 * (len(ratios) - 1))] if ratios else 1.0
    e_shape, c_shape = Counter(), Counter()
    for p in set(c_p) | set(e):
        e_shape[_shape_before(p) if p[:1] != "<" else p] += e[p]
        c_shape[_shape_before(p) if p[:1] != "<" else p] += c_p[p]
    model = Model()
    theta = {}
    for p in set(c_p) | set(e):
        k = _shape_before(p) if p[:1] != "<" else p
        prior = min(0.98, per_end * e_shape[k] / (c_shape[k] + 1.0))
        theta[p] = min(0.998, (per_end * e[p] + 2.0 * prior) / (c_p[p] + 2.0))
        model.before[p] = (theta[p] * c_p[p] + 0.02, (1 - theta[p]) * c_p[p] + 0.02)
    fb, fn = Counter(), Counter()
    for (p, f), n in sums.items():
        if theta[p] >= 0.9:
            fb[f] += n
        elif theta[p] <= 0.1:
            fn[f] += n
    tb, tn = sum(fb.values()) + 8.0, sum(fn.values()) + 8.0
    # A script without case says nothing by its form.
    model.form = {f: (1.0, 1.0) if f == "o" else ((fb[f] + 1.0) / tb, (fn[f] + 1.0) / tn) for f in {*fb, *fn, "U", "l", "d", "U0", "l0", "o0", "o"}}
    model.form["o0"] = (0.02, 0.02)
    inside_s = Counter()
    for _ in range(ROUNDS):
        n_s = sum(s.values()) + sum(inside_s.values()) + 1.0
        none = {a: max(0.0, c_a[a] - inside_s[a] - (0 if inside_s else per_end * s[a])) + 0.05 for a in set(c_a) | set(s)}
        n_n = sum(none.values())
        model.after = {a: ((s[a] + 0.5 * inside_s[a] + 0.01) / n_s, none[a] / n_n) for a in set(c_a) | set(s)}
        model.memo, model.pair = {}, {}
        inner, inner_p, kept, found = Counter(), Counter(), Counter(), Counter()
        for (p, a, f), n in places.items():
            expected = min(n, model.before[p][0] * model.after[a][0] * model.form[f][0] / (model.form["U"][0] if f in ("U", "o") else 1.0))
            inner[p, a] += n - expected
            inner_p[p] += n - expected
            kept[p] += n
        for p, n in c_p.items():  # what rare pairs have
            inner_p[p] += max(0, n - kept[p]) * (1 - theta[p])
        model.pair = {(p, a): x / (inner_p[p] + 0.02 * c_p[p] + 1.0) for (p, a), x in inner.items() if x > 0.05}
        for (p, a, f), n in places.items():
            found[a] += n / (1 + math.exp(-max(-30.0, min(30.0, model.odds(p, a, f)))))
        inside_s = found
    model.memo = {}
    pieces = float(sum(te.values()))
    least = max(3.0, SIDE_SHARE * pieces)
    model.thai_n = pieces
    model.thai_end = {k: n / pieces for k, n in te.items() if n >= least}
    model.thai_start = {k: n / pieces for k, n in ts.items() if n >= least}
    # Only places that could be boundaries are looked up; what is not here is as rare as the rarest that is kept.
    model.thai_rare = INNER_SHARE * pieces
    model.thai_inner = {k: float(n) for k, n in ti.items() if n >= model.thai_rare and k[:SIDE] in model.thai_end and k[SIDE:] in model.thai_start}
    return model


def _decided(odds: list[float], near: list[bool]) -> list[bool]:
    """Forward-backward over places by their log odds; near: that a boundary here and at the place before would have too little between them."""
    if len(odds) < 2 or all(abs(x) > 7 for x in odds) and not any(near):
        return [x > 0 for x in odds]
    local = [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in odds]
    fwd, y, n = [], 1.0, 0.0
    for i, q in enumerate(local):
        joint = 0.05 if near[i] else 1.0
        y, n = q * (n + y * joint if i else 1.0), (1 - q) * (n + y if i else 1.0)
        t = y + n
        y, n = y / t, n / t
        fwd.append((y, n))
    out, by, bn = [False] * len(local), 1.0, 1.0
    for i in range(len(local) - 1, -1, -1):
        y, n = fwd[i][0] * by, fwd[i][1] * bn
        out[i] = y > n
        joint, q = 0.05 if near[i] else 1.0, local[i]
        by, bn = q * joint * by + (1 - q) * bn, q * by + (1 - q) * bn
        t = by + bn
        by, bn = by / t, bn / t
    return out


def _posterior(model: Model, text: str, b: Block) -> list[bool]:
    """Forward-backward over a block's places; two boundaries with one word or less between them are held to be rare."""
    odds = [model.odds(p, a, f) for _, _, p, a, f in b.places]
    if len(odds) < 2 or all(abs(x) > 7 for x in odds):
        return [x > 0 for x in odds]
    near = [False] + [b.places[i][0] - b.places[i - 1][1] < 14 and " " not in text[b.places[i - 1][1] : b.places[i][0]] and text[b.places[i][0] - 1] not in FULL_STOPS for i in range(1, len(odds))]
    return _decided(odds, near)


def _run_on(model: Model, piece: str) -> list[int]:
    """Places inside a piece without spaces where one sentence ends and another starts, by forward-backward over its characters."""
    if len(piece) < 3 * SIDE:
        return []
    # Digits are one sign, so positions are mapped back.
    flat, at = [], []
    for k, ch in enumerate(piece):
        if ch.isdigit() and k and piece[k - 1].isdigit():
            continue
        flat.append("9" if ch.isdigit() else ch)
        at.append(k)
    s = "".join(flat)
    places, odds = [], []
    for k in range(SIDE, len(s) - SIDE + 1):
        end = model.thai_end.get(s[k - SIDE : k])
        start = end and model.thai_start.get(s[k : k + SIDE])
        if start:
            # Boundaries without a space expected here, against what the corpus has of these characters in a row.
            expected = RUN_ON * model.thai_n * end * start
            places.append(k)
            odds.append(math.log(expected / (max(model.thai_inner.get(s[k - SIDE : k + SIDE], 0.0), model.thai_rare) + 0.1)) - math.log(0.3))
    near = [False] + [places[i] - places[i - 1] < SIDE for i in range(1, len(places))]
    return [at[k] for k, yes in zip(places, _decided(odds, near), strict=True) if yes]


def cuts(text: str, model: Model) -> list[tuple[int, int]]:
    """Ends of units and starts of the next ones inside a block."""
    b = scan(text)
    if b.cuts is not None:
        return [(x, x) for x in b.cuts]
    edges = [p[:2] for p, yes in zip(b.places, _posterior(model, text, b), strict=True) if yes] if b.places else []
    edges += b.fixed
    if b.thai:
        edges += [(lo + k, lo + k) for lo, hi in _thai_pieces(b) for k in _run_on(model, text[lo:hi])]
    return sorted(set(edges)) if b.fixed or b.thai else edges


def units(text: str, model: Model, memo: dict[str, list] | None = None) -> tuple[list[int], list[int]]:
    """Starts and ends of the sentence units of a text, in code points."""
    starts, ends = [], []
    memo = {} if memo is None else memo
    for lo, block in block_spans(text):
        edges = memo.get(block)
        if edges is None:
            if len(memo) > MEMO:
                memo.clear()
            edges = memo[block] = cuts(block, model)
        at = 0
        for cut, nxt in [*edges, (len(block), len(block))]:
            if cut <= at:
                continue
            # A claim's number starts the next unit, so white space may stand before the cut, never after it.
            a, b = at, cut
            while b > a and block[b - 1].isspace():
                b -= 1
            if a < b:
                starts.append(lo + a)
                ends.append(lo + b)
            at = nxt
    return starts, ends


def fit_corpus(docs: DataFrame, text: str = "text") -> Model:
    """The model of all texts: counted per task, merged by key, and cut by share before the driver fits it.

    Types below MIN_SHARE of all places are merged into their form, so there are at most 1 / MIN_SHARE types on each side
    and a few dozen forms; pairs below PAIR_SHARE are merged into the form of their first word, so there are at most
    1 / PAIR_SHARE pairs, and types times forms of the rest. Contexts of characters are bounded by 1 / SIDE_SHARE and
    (places a piece) / INNER_SHARE. So what reaches the driver does not grow with the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()
        memo: dict[str, list] = {}

        def flush() -> pa.RecordBatch:
            pdf = pd.DataFrame([(*k, n) for k, n in out.items()], columns=["kind", "a", "b", "c", "n"])
            out.clear()
            return pa.RecordBatch.from_pandas(pdf, pa.schema([*((x, pa.string()) for x in "kind a b c".split()), ("n", pa.int64())]), preserve_index=False)

        with _no_cycle_collection():
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    count_events(t, out, memo)
                if len(out) > 200_000:
                    yield flush()
            yield flush()

    rows = docs.where(F.col(text) != "").select(F.col(text).alias("text")).mapInArrow(count, "kind string, a string, b string, c string, n long")
    sums = materialise(rows.groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n")))
    total = sums.where("kind in ('C','E','S')").agg(F.sum("n")).first()[0] or 0
    least = max(2.0, MIN_SHARE * total)
    # A type's count over all its rows decides whether it keeps its name.
    before = sums.where("kind in ('C','E')").groupBy("a").agg(F.sum("n").alias("m")).where(F.col("m") >= least).select("a", F.lit(True).alias("known"))
    after = sums.where("kind in ('C','S')").groupBy(F.when(F.col("kind") == "C", F.col("b")).otherwise(F.col("a")).alias("x"))
    after = after.agg(F.sum("n").alias("m")).where(F.col("m") >= least).select("x", F.lit(True).alias("known_x"))
    core = F.rtrim(F.col("a"), F.lit(".!?…"))
    shape = F.concat(F.lit("<"), F.least(F.length(core), F.lit(5)).cast("string"), F.substring(F.substr(F.col("a"), F.length(core) + 1), 1, 1), F.lit(">"))
    shape_x = F.concat(F.lit("<"), F.substring("form", 1, 1), F.when(F.length("x") == 1, "1").otherwise(""), F.lit(">"))
    known, named = F.coalesce("known", F.lit(False)), F.when(F.col("known_x"), F.col("x")).otherwise(shape_x)
    ends = sums.where("kind = 'E'").join(before, "a", "left").groupBy(F.when(known, F.col("a")).otherwise(shape).alias("a")).agg(F.sum("n").alias("n"))
    starts = sums.where("kind = 'S'").select(F.col("a").alias("x"), F.col("b").alias("form"), "n").join(after, "x", "left").groupBy(named.alias("a")).agg(F.sum("n").alias("n"))
    places = sums.where("kind = 'C'").select("a", F.col("b").alias("x"), F.col("c").alias("form"), "n").join(before, "a", "left").join(after, "x", "left")
    places = places.groupBy(F.when(known, F.col("a")).otherwise(shape).alias("a"), F.when(known, shape).otherwise(F.lit(None)).alias("backoff"), named.alias("b"), F.col("form").alias("c")).agg(F.sum("n").alias("n"))
    places = materialise(places)
    by_form = places.groupBy("a", "c").agg(F.sum("n").alias("n"))
    pairs = places.withColumn("a", F.when(F.col("n") >= PAIR_SHARE * total, F.col("a")).otherwise(F.coalesce("backoff", "a"))).groupBy("a", "b", "c").agg(F.sum("n").alias("n"))
    pieces = sums.where("kind = 'e'").agg(F.sum("n")).first()[0] or 0
    sides = sums.where(F.col("kind").isin("e", "s") & (F.col("n") >= SIDE_SHARE * pieces) | (F.col("kind") == "i") & (F.col("n") >= INNER_SHARE * pieces))
    # All pieces, whatever their ends: the parts are of these.
    rest = sums.where((F.col("kind") == "e") & (F.col("n") < SIDE_SHARE * pieces)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def counter(df: DataFrame, *keys: str) -> Counter:
        return Counter({tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r["n"] for r in df.toLocalIterator()})

    te, ts, ti = _sides({(r.kind, r.a, r.b, r.c): r.n for r in sides.toLocalIterator()})
    te[""] += rest
    return _fit(counter(pairs, "a", "b", "c"), counter(ends, "a"), counter(starts, "a"), counter(by_form, "a", "c"), te, ts, ti)


def sentence_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, start_char, end_char: the sentence units of each text, from 0, start included, end excluded, without white space around.

    All text but white space lies in exactly one unit. Null, empty and blank texts have no rows; a null id is kept.
    Repeated rows give repeated units. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    if model is None:
        model = fit_corpus(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.where(F.col(text) != "").select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        with _no_cycle_collection():
            for batch in batches:
                starts, ends, sizes = [], [], []
                for t in batch.column(1).to_pylist():
                    a, b = units(t, m, m.blocks)
                    starts += a
                    ends += b
                    sizes.append(len(a))
                of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "start_char", "end_char"])

    return base.mapInArrow(split, f"doc_id {dict(base.dtypes)['doc_id']}, start_char int, end_char int")
