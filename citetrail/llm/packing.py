"""Filling fixed-capacity containers with documents (problem 8), by lexical retrieval packing.

Documents go to shards of bounded size by content: a tree of cuts through sketches of their token bags keeps what is alike
in one shard. A shard scores all its pairs by BM25, with frequencies and mean length of the whole collection: the largest
unused item seeds a container, its unused neighbours by BM25 fill the window greedily, and the room that is left takes the
largest unused item that fits, so containers are full and what stands together is alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetrail.llm.tokens import FREQUENCIES, VOCABULARY, token_bags
from citetrail.runtime import materialise

#: Documents aimed at per shard.
SHARD_DOCS = 4_000
#: Dimensions of a sketch, and documents sampled per shard, and at most, to place the cuts: with more documents than fit
#: LEAST sampled ones per shard the shards of one leaf are told apart by hash.
DIMENSIONS, PER_SHARD, SAMPLE, LEAST = 96, 100, 200_000, 16
#: Documents of a term from which its scores are multiplied densely.
DENSE = 256
#: Quantile of item sizes that a neighbour must leave room for, and the part of a container it may leave unused.
USUAL, TIGHT = 0.5, 0.004
# The usual BM25 parameters.
K1, B = 1.2, 0.75


class Stats:
    """Documents, mean length and document frequencies (by token id) of a collection."""

    def __init__(self, n: int, mean: float, df: np.ndarray) -> None:
        self.n, self.mean, self.idf = n, max(mean, 1e-9), np.log1p((n - df + 0.5) / (df + 0.5))

    def impact(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray | float) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))


class Bm25:
    """Scores of all pairs of bags of token ids: a bag's every term is asked. Without stats the bags are the collection."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], stats: Stats | None = None) -> None:
        self.n = n = len(bags)
        self.scores = np.zeros((n, n), np.float32)
        if not n:
            return
        sizes = np.array([len(i) for i, _ in bags], np.int64)
        term = np.concatenate([i for i, _ in bags]).astype(np.int64)
        tf = np.concatenate([t for _, t in bags]).astype(np.float64)
        doc = np.repeat(np.arange(n), sizes)
        length = np.bincount(doc, tf, n)
        df = np.bincount(term, minlength=int(term.max()) + 1 if len(term) else 1)
        impact = (stats or Stats(n, length.mean(), df)).impact(term, tf, length[doc]).astype(np.float32)
        by_term = np.argsort(term, kind="stable")
        docs, impacts, first = doc[by_term], impact[by_term], np.concatenate([[0], np.cumsum(df)])
        frequent = np.flatnonzero(df >= DENSE)
        for k in range(0, len(frequent), 512):
            part = frequent[k : k + 512]
            has, weight = np.zeros((n, len(part)), np.float32), np.zeros((n, len(part)), np.float32)
            for c, t in enumerate(part):
                span = slice(first[t], first[t + 1])
                has[docs[span], c], weight[docs[span], c] = 1, impacts[span]
            self.scores += has @ weight.T
        rare = df < DENSE
        at = np.concatenate([[0], np.cumsum(sizes)])
        for d in range(n):
            own = term[at[d] : at[d + 1]]
            spans = [slice(first[t], first[t + 1]) for t in own[rare[own]]]
            if spans:
                self.scores[d] += np.bincount(np.concatenate([docs[x] for x in spans]), np.concatenate([impacts[x] for x in spans]), n)

    def neighbours(self, d: int, unused: np.ndarray, most: int) -> np.ndarray:
        """Unused documents that share terms with d, best first; of equal ones the earlier."""
        score = np.where(unused, self.scores[d], 0)
        hits = np.flatnonzero(score)
        if len(hits) > most:
            hits = hits[score[hits] >= np.partition(score[hits], -most)[-most]]
        return hits[np.lexsort((hits, -score[hits]))][:most]


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    return np.random.default_rng(0).standard_normal((1 << 16, DIMENSIONS), np.float32)


def sketches(pdf: pd.DataFrame, stats: Stats) -> np.ndarray:
    """Random projections of BM25 impacts, of length 1: their products estimate how alike bags are."""
    out = np.zeros((len(pdf), DIMENSIONS), np.float32)
    for k, (i, t, n) in enumerate(zip(pdf["ids"], pdf["tfs"], pdf["tokens"], strict=True)):
        term, tf = np.frombuffer(i, np.uint16), np.frombuffer(t, np.uint32).astype(np.float64)
        out[k] = stats.impact(term, tf, float(n)).astype(np.float32) @ _signs()[term]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def cut_tree(sample: np.ndarray, most: float) -> list[tuple[np.ndarray, float, int, int]]:
    """Nodes (direction, threshold, low, high) of a tree whose leaves hold at most so many of the sample; -1 - leaf ends a path. Cuts lie in the widest gap near the middle of the main direction."""
    nodes: list = []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        x = sample[rows]
        if len(rows) > max(most, 1):
            # The main direction, of centred rows: by eigenvectors of a small matrix.
            way = np.linalg.eigh(np.cov(x, rowvar=False))[1][:, -1].astype(np.float32)
            at = x @ way
            values = np.sort(at)
            lo, hi = len(values) // 4, len(values) - len(values) // 4
            gaps = np.diff(values[lo:hi])
            if len(gaps) and gaps.max() > 1e-6:
                g = lo + int(gaps.argmax())
                cut = float((values[g] + values[g + 1]) / 2)
                me = len(nodes)
                nodes.append(None)
                low, high = grow(rows[at <= cut]), grow(rows[at > cut])
                nodes[me] = (way, cut, low, high)
                return me
        leaves += 1
        return -leaves

    grow(np.arange(len(sample)))
    return nodes


def leaf_of(vectors: np.ndarray, nodes: list[tuple[np.ndarray, float, int, int]]) -> np.ndarray:
    out, todo = np.zeros(len(vectors), np.int64), [(0, np.arange(len(vectors)))] if nodes else []
    while todo:
        node, rows = todo.pop()
        way, cut, low, high = nodes[node]
        above = vectors[rows] @ way > cut
        for child, part in ((low, rows[~above]), (high, rows[above])):
            if not len(part):
                continue
            if child < 0:
                out[part] = -1 - child
            else:
                todo.append((child, part))
    return out


def collection_stats(bags: DataFrame, frequencies: DataFrame) -> Stats:
    """From the bags' sizes and the tasks' rows of frequencies, which are summed by token; at most one row per token id reaches the driver."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, t in zip(pdf["ids"], pdf["tfs"], strict=True):
                yield pd.DataFrame({"term": np.frombuffer(i, np.uint16).astype(np.int64), "df": np.frombuffer(t, np.uint32).astype(np.int64)})

    df = np.zeros(1 << 16, np.int64)
    for r in frequencies.select("ids", "tfs").mapInPandas(rows, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    n, mean = bags.agg(F.count(F.lit(1)), F.avg("tokens")).first()
    return Stats(n, mean or 0.0, df)


def placed_by_content(bags: DataFrame, stats: Stats, shard_docs: int) -> DataFrame:
    """bags with shard: leaves of a tree of cuts, and parts of a leaf that holds over 1.5 times the documents aimed at."""
    # Equal ids or texts must not make one shard large: what differs between rows takes part in the hash.
    key = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("ids", "tfs")))
    shards = -(-stats.n // shard_docs)
    if shards < 2:
        return bags.withColumn("shard", F.lit(0))
    want = min(shards * PER_SHARD, SAMPLE)
    each = want / stats.n

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"v": [v.tobytes() for v in sketches(pdf, stats).astype(np.float16)]})

    drawn = bags.where(F.pmod(key, F.lit(1_000_000)) < int(each * 1_000_000) + 1).mapInPandas(draw, "v binary").orderBy("v").collect()
    sample = np.array([np.frombuffer(r.v, np.float16) for r in drawn], np.float32).reshape(-1, DIMENSIONS)
    nodes = cut_tree(sample, max(LEAST, shard_docs * len(sample) / stats.n)) if len(sample) else []

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(leaf=leaf_of(sketches(pdf, stats), nodes))

    found = materialise(bags.mapInPandas(find, ", ".join(f"{c} {k}" for c, k in bags.dtypes) + ", leaf long"))
    first, at = [], 0
    for r in found.groupBy("leaf").count().orderBy("leaf").collect():
        n = max(1, -(-2 * r["count"] // (3 * shard_docs)))
        first.append((r.leaf, at, n))
        at += n
    plan = F.broadcast(bags.sparkSession.createDataFrame(first, "leaf long, first long, parts long"))
    return found.join(plan, "leaf").withColumn("shard", (F.col("first") + F.pmod(key, F.col("parts"))).cast("int")).drop("leaf", "first", "parts")


#: How an item came to its container: a piece as large as it, its seed, a neighbour of the seed, the best fit, no tokens.
PIECE, SEED, NEIGHBOUR, FIT, EMPTY = "piece", "seed", "neighbour", "fit", "empty"
Item = tuple[int, int, int, int, str]


def pack(sizes: np.ndarray, capacity: int, index: Bm25) -> list[list[Item]]:
    """Containers as lists of (document, piece, first token, tokens, how it came there). Documents of no tokens lie in the first container."""
    bins: list[list[Item]] = []
    whole = sizes // capacity
    for d in np.flatnonzero(whole):
        bins.extend([(int(d), k, k * capacity, capacity, PIECE)] for k in range(whole[d]))
    rest = sizes - whole * capacity
    unused = rest > 0
    # Items by size, with a pointer from each place to the nearest unused one at or below it.
    order = np.argsort(rest, kind="stable")
    place = np.empty(len(rest), np.int64)
    place[order] = np.arange(len(rest))
    sorted_rest = rest[order]
    below = list(range(-1, len(rest)))  # below[p + 1]: nearest unused place <= p

    def nearest(p: int) -> int:
        root = p + 1
        while below[root] != root - 1:
            root = below[root] + 1
        while below[p + 1] != root - 1:
            below[p + 1], p = root - 1, below[p + 1]
        return root - 1

    def take(d: int, bin_: list[Item], how: str) -> int:
        unused[d] = False
        below[place[d] + 1] = place[d] - 1
        bin_.append((int(d), int(whole[d]), int(whole[d] * capacity), int(rest[d]), how))
        return int(rest[d])

    some = sorted_rest[sorted_rest > 0]
    usual, tight = (int(np.quantile(some, USUAL)) if len(some) else 0), capacity * TIGHT
    least = int(np.searchsorted(sorted_rest, 1))  # items without tokens lie before
    for p in range(least):
        below[p + 1] = -1 if p == 0 else p - 1
    while (p := nearest(len(rest) - 1)) >= least:
        seed = order[p]
        bin_: list[Item] = []
        room = capacity - take(seed, bin_, SEED)
        smallest = sorted_rest[least]
        if room >= smallest:
            # What does not fit now never will, and the first one taken must be good now.
            left = room - rest
            can = unused & (left >= 0)
            score = np.where(can, index.scores[seed], 0) if (can & ((left >= usual) | (left <= tight))).any() else np.zeros(0)
            near = np.flatnonzero(score > 0)  # unused neighbours; taken best first, of equal ones the earlier
            score, fits = score[near], rest[near]
            while room >= smallest and len(near):
                left = room - fits
                # A neighbour may leave room that items usually fill, or next to none; the last place is for the best fit.
                good = (left >= usual) | ((left >= 0) & (left <= tight))
                k = int(np.where(good, score, 0).argmax())
                if not good[k]:
                    break
                room -= take(near[k], bin_, NEIGHBOUR)
                # What was passed over did not fit then.
                after = score < score[k]
                after[k + 1 :] |= score[k + 1 :] == score[k]
                near, score, fits = near[after], score[after], fits[after]
        while room >= smallest:
            p = nearest(int(np.searchsorted(sorted_rest, room, "right")) - 1)
            if p < least:
                break
            room -= take(order[p], bin_, FIT)
        bins.append(bin_)
    empty = [(int(d), 0, 0, 0, EMPTY) for d in np.flatnonzero(sizes == 0)]
    if empty:
        bins = [[*bins[0], *empty], *bins[1:]] if bins else [empty]
    return bins


def pack_documents(docs: DataFrame, specs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """container, bin, position, doc_id, piece, token_start, tokens, came: every document's place in containers of each capacity, and how it came there (PIECE, SEED, NEIGHBOUR, FIT, EMPTY).

    A document is cut only when larger than the container: into full pieces and a rest, which is packed like a document.
    Documents without tokens (null or empty texts) have a row of no tokens in a container of their shard. Rows with equal
    ids, and null ids, are documents of their own. Of specs given twice the larger capacity counts; capacities below 1 or
    null are left out. Empty tables give no rows. Other columns, whatever their names, are not read. `specs` is a
    table of a few rows and is collected.
    """
    wanted = specs.where("container is not null and capacity_tokens >= 1").groupBy("container").agg(F.max("capacity_tokens").alias("c")).orderBy("container").collect()
    capacities = [(r.container, int(r.c)) for r in wanted]
    counted = materialise(token_bags(docs, doc_id, text, vocabulary))
    bags = counted.where(F.col("tokens") != FREQUENCIES)
    id_kind = dict(bags.dtypes)["doc_id"]
    stats = collection_stats(bags, counted.where(F.col("tokens") == FREQUENCIES))
    placed = placed_by_content(bags, stats, shard_docs)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "tokens"], ignore_index=True)
        index = Bm25([(np.frombuffer(i, np.uint16), np.frombuffer(t, np.uint32)) for i, t in zip(pdf["ids"], pdf["tfs"], strict=True)], stats)
        sizes, ids, shard = pdf["tokens"].to_numpy(np.int64), pdf["doc_id"].to_numpy(), int(pdf["shard"].iloc[0])
        out = []
        for name, capacity in capacities:
            for b, items in enumerate(pack(sizes, capacity, index)):
                out.extend((name, (shard << 32) + b, k, ids[d], piece, start, n, came) for k, (d, piece, start, n, came) in enumerate(items))
        return pd.DataFrame(out, columns=["container", "bin", "position", "doc_id", "piece", "token_start", "tokens", "came"])

    return placed.groupBy("shard").applyInPandas(fill, f"container string, bin long, position int, doc_id {id_kind}, piece int, token_start long, tokens long, came string")


def packing_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """container, capacity_tokens, bins, tokens, unused_tokens, fill, cut_documents, retrieved_part: how full the containers are, and the part of what was added to seeds that was retrieved as their neighbours (null if nothing was)."""
    per = packed.groupBy("container", "bin").agg(F.sum("tokens").alias("tokens")).where("tokens > 0").groupBy("container").agg(F.count(F.lit(1)).alias("bins"), F.sum("tokens").alias("tokens"))
    cut = packed.where("piece > 0").groupBy("container").agg(F.count_distinct("doc_id").alias("cut_documents"))
    added = packed.where(F.col("came").isin(NEIGHBOUR, FIT)).groupBy("container").agg(F.round(F.avg((F.col("came") == NEIGHBOUR).cast("double")), 4).alias("retrieved_part"))
    cap = F.col("capacity_tokens").cast("long")
    return (
        per.join(specs.groupBy("container").agg(F.max("capacity_tokens").alias("capacity_tokens")), "container")
        .join(cut, "container", "left")
        .join(added, "container", "left")
        .select("container", cap.alias("capacity_tokens"), "bins", "tokens", (F.col("bins") * cap - F.col("tokens")).alias("unused_tokens"), F.round(F.col("tokens") / (F.col("bins") * cap), 4).alias("fill"), F.coalesce("cut_documents", F.lit(0)).alias("cut_documents"), "retrieved_part")
    )


