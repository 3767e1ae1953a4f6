from __future__ import annotations

import os

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from citetrail.llm import packing as P
from citetrail.llm import tokens as T

HAS = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary here")


def bags(sizes, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for s in sizes:
        i, t = np.unique(rng.integers(0, 50, min(int(s), 40)), return_counts=True)
        out.append((i.astype(np.uint16), t.astype(np.uint32)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 90), max_size=40), st.integers(1, 40))
def test_pack(sizes, capacity):
    s = np.array(sizes, np.int64)
    bins = P.pack(s, capacity, P.Bm25(bags(sizes)))
    pieces = {}
    for b in bins:
        assert sum(n for _, _, _, n, _ in b) <= capacity
        for d, piece, start, n, _ in b:
            pieces.setdefault(d, []).append((piece, start, n))
    assert sorted(pieces) == list(range(len(sizes)))
    for d, ps in pieces.items():
        ps.sort()
        assert sum(n for *_, n in ps) == sizes[d] and [p[1] for p in ps] == [k * capacity for k in range(len(ps))]
        assert len(ps) == max(1, -(-sizes[d] // capacity))
    # First fit never leaves two containers that could be one.
    loads = sorted(sum(n for _, _, _, n, _ in b) for b in bins)
    assert len(loads) < 2 or loads[0] + loads[1] > capacity or loads[0] == 0


def test_neighbours_are_alike():
    ids = [np.array(x, np.uint16) for x in ([1, 2, 3], [1, 2, 4], [7, 8, 9], [7, 8, 3])]
    index = P.Bm25([(i, np.ones(len(i), np.uint16)) for i in ids])
    assert index.neighbours(0, np.array([False, True, True, True]), 9)[0] == 1
    assert index.neighbours(2, np.array([True, True, False, False]), 9).tolist() == []


@HAS
def test_operator(spark):
    rows = [(i, "alpha beta gamma " * (1 + i % 7)) for i in range(60)] + [(100, "long text here " * 400), (101, ""), (102, None), (7, "twice"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, shard string")
    specs = spark.createDataFrame([("s", 20), ("s", 32), ("m", 200), ("bad", 0), (None, 9)], "container string, capacity_tokens int")
    out = P.pack_documents(docs, specs, shard_docs=20)
    got = out.collect()
    enc = T.encoding(T.VOCABULARY)
    total = sum(len(enc.encode_ordinary(t or "")) for _, t in rows)
    for name, cap in (("s", 32), ("m", 200)):
        mine = [r for r in got if r.container == name]
        loads = {}
        for r in mine:
            loads[r.bin] = loads.get(r.bin, 0) + r.tokens
        assert max(loads.values()) <= cap and sum(loads.values()) == total
        assert {r.doc_id for r in mine} == {i for i, _ in rows}
    assert {r.container for r in got} == {"s", "m"}
    assert {r.container: r.tokens for r in P.packing_report(out, specs).collect()} == {"s": total, "m": total}
    assert {r.container: r.retrieved_part for r in P.packing_report(out, specs).collect()}["s"] == round(sum(r.came == P.NEIGHBOUR for r in got if r.container == "s") / max(1, sum(r.came in (P.NEIGHBOUR, P.FIT) for r in got if r.container == "s")), 4)
    assert P.pack_documents(docs.limit(0), specs).count() == 0


@HAS
def test_token_sizes(spark):
    got = T.token_sizes(spark.createDataFrame([(1, "hello world", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r.doc_id, r.tokens > 0) for r in got] == [(1, True), (2, False)]


def test_common_terms_and_distant_candidates_count():
    """A neighbour may share only terms beyond the first 16, and the neighbour that fits may be beyond the first 64."""
    own = np.arange(100, 120, dtype=np.uint16)
    twice = [(own[:16], np.ones(16, np.uint16))]
    query = (np.concatenate([[1], own]).astype(np.uint16), np.ones(21, np.uint16))
    tail = [(np.array([1, 200 + i], np.uint16), np.ones(2, np.uint16)) for i in range(30)]
    index = P.Bm25([query, *twice, *tail])
    assert set(index.neighbours(0, np.arange(32) > 0, 99)) == set(range(1, 32))
    n = 90
    alike = P.Bm25([(np.array([5, 6], np.uint16), np.ones(2, np.uint16))] + [(np.array([5, 6], np.uint16), np.ones(2, np.uint16))] * (n - 2) + [(np.array([5], np.uint16), np.ones(1, np.uint16))])
    sizes = np.array([60] + [50] * (n - 2) + [40], np.int64)
    assert P.pack(sizes, 100, alike)[0] == [(0, 0, 0, 60, P.SEED), (n - 1, 0, 0, 40, P.NEIGHBOUR)]


def test_relatives_share_a_shard(spark):
    rng = np.random.default_rng(1)
    rows = []
    for topic in range(40):
        ids = np.unique(rng.integers(topic * 500, topic * 500 + 500, 60)).astype(np.uint16)
        for k in range(10):
            mine = np.delete(ids, k)
            rows.append((topic * 10 + k, len(mine), mine.tobytes(), np.ones(len(mine), np.uint32).tobytes()))
    bags = spark.createDataFrame(rows, "doc_id long, tokens long, ids binary, tfs binary")
    term, df = np.unique(np.concatenate([np.frombuffer(r[2], np.uint16) for r in rows]), return_counts=True)
    freq = spark.createDataFrame([(bytearray(x.tobytes()), bytearray(y.astype(np.uint32).tobytes())) for x, y in ((term[::2], df[::2]), (term[1::2], df[1::2]), (term[:3], 0 * df[:3]))], "ids binary, tfs binary")
    got = {r.doc_id: r.shard for r in P.placed_by_content(bags, P.collection_stats(bags, freq), 100).collect()}
    loads = {s: list(got.values()).count(s) for s in got.values()}
    assert len(got) == 400 and len(loads) >= 4 and max(loads.values()) <= 150
    assert sum(len({got[t * 10 + k] for k in range(10)}) == 1 for t in range(40)) >= 36


@HAS
def test_frequencies_ride_along(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta alpha", "beta gamma", "", None, "beta"])], "doc_id long, text string").repartition(2)
    rows = T.token_bags(docs).collect()
    marks = [r for r in rows if r.tokens == T.FREQUENCIES]
    want = np.zeros(1 << 16, int)
    for r in rows:
        if r.tokens != T.FREQUENCIES:
            want[np.frombuffer(r.ids, np.uint16)] += 1
    got = np.zeros(1 << 16, int)
    for r in marks:
        got[np.frombuffer(r.ids, np.uint16)] += np.frombuffer(r.tfs, np.uint32)
    assert len(rows) - len(marks) == 5 and len(marks) <= 2 and (got == want).all() and want.max() >= 2


@HAS
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é9.'sdrevl \n\t\u00a0\x1c中。")), max_size=30))
def test_pattern(text):
    """As the pattern's plain form splits."""
    plain = tiktoken.Encoding("plain", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=T.encoding(T.VOCABULARY)._mergeable_ranks, special_tokens={})
    assert T.encoding(T.VOCABULARY).encode_ordinary(text) == plain.encode_ordinary(text)
