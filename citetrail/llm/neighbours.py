"""Most similar vectors for every vector (problem 6), by robust-pruned directed graphs.

Vectors go to the shard of their nearest pivot (spherical k-means on a bounded sample), and to that of a second pivot
nearly as close. Shards above their size are cut by pivots of their own, level by level, until none is, so a shard's size
does not depend on the collection's; a vector is in `levels` + 2 shards at most. A shard builds a directed graph: greedy
searches propose neighbours for every vector, pruning by relaxed distances keeps diverse edges, reverse edges are added
and pruned alike. A beam search from each vector then yields candidates, which are ranked by their exact cosine.

Copies of one vector are collapsed per task before vectors move and once more in the shard, so a vector shared by a
third of all rows is one node; its ids join back by the vector's hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citetrail.runtime import drop, join_sized, materialise

#: Sampled vectors a pivot is fitted on.
PER_PIVOT = 16
#: Vectors one task assigns to the pivots of a shard that is cut.
TASK_VECTORS = 20_000
#: Shards aimed at per task where there are very many.
MOST_PARTITIONS = 20_000


@dataclass(frozen=True)
class IndexParams:
    """dims: length of a usable vector. fanout: most pivots of one level, fitted on PER_PIVOT sampled vectors each.
    shard: vectors aimed at per shard; over fanout shards, exact counts keep each below twice as many; up to fanout
    shards the sample's estimate does, so one may be a little larger. levels: of further cuts; a shard still too
    large then (nearly equal vectors) is cut by the hash of its vectors. near: a vector also goes to a second pivot whose
    cosine is within this of the best. degree, beam, alpha: of the graph. plane: dimensions of the projection that guides
    searches (exact cosines decide)."""

    dims: int = 768
    fanout: int = 256
    shard: int = 2500
    levels: int = 4
    near: float = 0.03
    degree: int = 16
    beam: int = 24
    alpha: float = 1.2
    plane: int = 96
    seed: int = 7


def usable(vectors: pd.Series, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors (dims finite values, not all zero), and those scaled to length 1."""
    at = np.array([i for i, v in enumerate(vectors) if isinstance(v, (np.ndarray, list)) and len(v) == dims], dtype=np.int64)
    if not len(at):
        return at, np.zeros((0, dims), np.float32)
    x = np.array([vectors.iat[i] for i in at], dtype=np.float64)  # a null value becomes no number
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    at, x = at[ok], x[ok]
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return at, x.astype(np.float32)


def _pivots(x: np.ndarray, k: int, share: float, seed: int) -> np.ndarray:
    """Spherical k-means with k pivots, and more where a pivot's part of the sample is above `share`."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for turn in range(20):
        own = np.argmax(x @ c.T, axis=1)
        count = np.bincount(own, minlength=len(c))
        if turn >= 8 and len(c) < 4 * k:
            over = np.flatnonzero((count > share * len(x)) & (count > 2))[: 4 * k - len(c)]
            if turn > 10 and not len(over):
                break
            # A second pivot beside each that has too much: one of its own vectors.
            c = np.concatenate([c, np.array([x[rng.choice(np.flatnonzero(own == j))] for j in over], np.float32).reshape(-1, x.shape[1])])
            own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            m = x[own == j]
            c[j] = m.sum(axis=0) if len(m) else x[rng.integers(len(x))]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _choose(x: np.ndarray, pivots: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest pivot, and the second one where it is nearly as close (else -1)."""
    s = x @ pivots.T
    rows = np.arange(len(x))
    first = np.argmax(s, axis=1)
    best = s[rows, first]
    s[rows, first] = -2.0
    second = np.argmax(s, axis=1)
    return first, np.where((s[rows, second] >= best - near) & (len(pivots) > 1), second, -1)


def _beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cosines of the `beam` best nodes each query's greedy search has met (-1: none), all queries in step."""
    n, b = len(x), len(q)
    ids = np.full((b, beam), -1, np.int64)
    sim = np.full((b, beam), -2.0, np.float32)
    done = np.ones((b, beam), bool)
    w = min(start.shape[1], beam)
    ids[:, :w] = start[:, :w]
    sim[:, :w] = np.einsum("bkd,bd->bk", x[ids[:, :w]], q)
    done[:, :w] = False
    sim[ids < 0] = -2.0
    rows = np.arange(b)
    for _ in range(steps):
        open_sim = np.where(done, -3.0, sim)
        best = np.argmax(open_sim, axis=1)
        live = open_sim[rows, best] > -2.0
        if not live.any():
            break
        r = rows[live]
        done[r, best[live]] = True
        nb = graph[ids[r, best[live]]]
        s = np.einsum("bkd,bd->bk", x[nb], q[r])
        s[nb < 0] = -2.0
        # What the beam has already is not met again.
        s[(nb[:, :, None] == ids[r][:, None, :]).any(axis=2)] = -2.0
        all_ids = np.concatenate([ids[r], nb], axis=1)
        all_sim = np.concatenate([sim[r], s], axis=1)
        all_done = np.concatenate([done[r], s <= -2.0], axis=1)
        top = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
        ids[r] = np.take_along_axis(all_ids, top, 1)
        sim[r] = np.take_along_axis(all_sim, top, 1)
        done[r] = np.take_along_axis(all_done, top, 1)
    ids[sim <= -2.0] = -1
    return ids, sim


def _robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node at most `degree` of its candidates: the nearest stays, and what lies closer to it than alpha allows goes, again and again."""
    out = np.full((len(nodes), degree), -1, np.int64)
    for lo in range(0, len(nodes), 512):
        p, c = nodes[lo : lo + 512], cand[lo : lo + 512]
        xc = x[c]
        d = 2 - 2 * np.einsum("bkd,bd->bk", xc, x[p])
        dead = (c < 0) | (c == p[:, None])
        order = np.argsort(np.where(dead, np.inf, d), axis=1)
        c, d, dead = (np.take_along_axis(a, order, 1) for a in (c, d, dead))
        dead[:, 1:] |= c[:, 1:] == c[:, :-1]  # equal ids lie side by side where distances are equal
        xc = np.take_along_axis(xc, order[:, :, None], 1)
        between = 2 - 2 * np.matmul(xc, xc.transpose(0, 2, 1))
        rows = np.arange(len(p))
        for k in range(degree):
            first = np.argmax(~dead, axis=1)
            live = ~dead[rows, first]
            if not live.any():
                break
            out[lo + rows[live], k] = c[rows[live], first[live]]
            dead |= (alpha * between[rows, first] <= d) & live[:, None]
            dead[rows, first] = True
    return out


def build_graph(x: np.ndarray, degree: int, beam: int, alpha: float, seed: int) -> tuple[np.ndarray, int]:
    """Out-edges (rows padded with -1) over unit vectors, and the entry node."""
    n = len(x)
    rng = np.random.default_rng(seed)
    entry = int(np.argmax(x @ x.mean(axis=0)))
    graph = rng.integers(0, n, (n, degree)) if n > 1 else np.full((n, degree), -1, np.int64)
    for turn in (1.0, alpha):
        order = rng.permutation(n)
        for lo in range(0, n, max(256, n // 6)):
            p = order[lo : lo + max(256, n // 6)]
            start = np.full((len(p), 3), entry)
            start[:, 1:] = rng.integers(0, n, (len(p), 2))
            ids, _ = _beam_search(x, graph, x[p], start, beam, beam + 8)
            graph[p] = _robust_prune(x, p, np.concatenate([ids, graph[p]], axis=1), degree, turn)
            # Reverse edges: each target takes what points at it, nearest first, and is pruned again.
            src, dst = np.repeat(p, degree), graph[p].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            near = np.einsum("ed,ed->e", x[src], x[dst])
            by = np.lexsort((-near, dst))
            src, dst = src[by], dst[by]
            targets, first, count = np.unique(dst, return_index=True, return_counts=True)
            rank = np.arange(len(dst)) - np.repeat(first, count)
            keep = rank < degree
            incoming = np.full((len(targets), degree), -1, np.int64)
            incoming[np.repeat(np.arange(len(targets)), count)[keep], rank[keep]] = src[keep]
            graph[targets] = _robust_prune(x, targets, np.concatenate([graph[targets], incoming], axis=1), degree, turn)
    return graph, entry


def shard_neighbours(x: np.ndarray, k: int, least: float, p: IndexParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, cosine) for up to k other vectors of the shard with cosine >= least, for every vector of it."""
    n = len(x)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    rng = np.random.default_rng(p.seed)
    plane = x @ np.linalg.qr(rng.standard_normal((x.shape[1], min(p.plane, x.shape[1]))))[0].astype(np.float32)
    plane /= np.maximum(np.linalg.norm(plane, axis=1, keepdims=True), 1e-9)
    graph, entry = build_graph(plane, p.degree, p.beam, p.alpha, p.seed)
    found_q, found_n, found_s = [], [], []
    for lo in range(0, n, 2048):
        q = np.arange(lo, min(lo + 2048, n))
        start = np.full((len(q), 4), entry)
        start[:, 1:3] = rng.integers(0, n, (len(q), 2))
        start[:, 3] = q
        start[:, 1:][start[:, 1:] == start[:, :-1]] = -1
        ids, _ = _beam_search(plane, graph, plane[q], start, p.beam, p.beam + 8)
        exact = np.einsum("bkd,bd->bk", x[ids], x[q])
        exact[(ids < 0) | (ids == q[:, None])] = -2.0
        top = np.argsort(-exact, axis=1)[:, :k]
        s = np.take_along_axis(exact, top, 1)
        hit = s >= least
        found_q.append(np.repeat(q, hit.sum(axis=1)))
        found_n.append(np.take_along_axis(ids, top, 1)[hit])
        found_s.append(s[hit])
    return np.concatenate(found_q), np.concatenate(found_n), np.concatenate(found_s)


def _hashes(x: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(r.tobytes()) for r in x]


def _rows(shard: np.ndarray, h: list[bytes] | np.ndarray, x: list[bytes] | np.ndarray, first: bool) -> pd.DataFrame:
    return pd.DataFrame({"shard": shard, "h": h, "x": x, "first": first}, columns=["shard", "h", "x", "first"])


SHARDED = "shard long, h binary, x binary, first boolean"


def shards_of(vectors: DataFrame, n: int, p: IndexParams) -> tuple[DataFrame, int]:
    """shard, h, x, first and the number of shards: the distinct unit vectors of `vector` in their shards. h is a vector's hash, first its nearest shard.

    Copies may remain, of the same shard; they are collapsed per task here and in the shard.
    """
    k = max(1, min(round(n / p.shard), p.fanout))
    most = PER_PIVOT * p.fanout
    # The bounded sample: every row with the same chance, by the hash of its vector's first values.
    part = min(1.0, 1.5 * max(most, 1024) / max(n, 1))
    picked = vectors.where(F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(1_000_000)) < int(part * 1_000_000) + 1).select("vector").limit(2 * most).toPandas()
    _, sample = usable(picked["vector"], p.dims)
    sample = sample[:most]
    if not len(sample):
        sample = np.eye(1, p.dims, dtype=np.float32)
    pivots = vectors.sparkSession.sparkContext.broadcast(_pivots(sample, k, 1.3 * p.shard / max(n, 1), p.seed))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piv = pivots.value
        seen: set[bytes] = set()
        for pdf in batches:
            _, x = usable(pdf["vector"], p.dims)
            h = _hashes(x)
            new = []
            for i, v in enumerate(h):
                if v not in seen:
                    seen.add(v)
                    new.append(i)
            if len(seen) > 1_000_000:
                seen.clear()
            if new:
                yield from _placed(x[new], np.array([h[i] for i in new], object), [r.tobytes() for r in x[new]], piv, p.near, 0, np.ones(len(new), bool))

    sent = vectors.select("vector").mapInPandas(assign, SHARDED)
    if n <= p.fanout * p.shard:
        return sent, len(pivots.value)
    return _cut(materialise(sent), p)


def _placed(x: np.ndarray, h: np.ndarray, raw: list[bytes] | np.ndarray, pivots: np.ndarray, near: float, base: int, first: np.ndarray) -> Iterator[pd.DataFrame]:
    """The vectors in the shards of their pivots; only what lay in its nearest shard so far also goes to a second."""
    raw = np.array(raw, object)
    one, two = _choose(x, pivots, near)
    yield pd.DataFrame({"shard": base + one, "h": h, "x": raw, "first": first})
    also = first & (two >= 0)
    if also.any():
        yield pd.DataFrame({"shard": base + two[also], "h": h[also], "x": raw[also], "first": False})


def _fit_and_split(p: IndexParams) -> tuple[Callable[[pd.DataFrame], pd.DataFrame], Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]]:
    """For the sample of one shard that is cut its pivots; and for vectors of it, with those pivots, the shards they go to."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["x"]), np.float32).reshape(len(pdf), -1)
        n = int(pdf["n"].iloc[0])
        c = _pivots(x, max(2, min(p.fanout, round(1.3 * n / p.shard))), 1.3 * p.shard / n, p.seed)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "pivots": [c.tobytes()], "salts": [pdf["salts"].iloc[0]]})

    def split(vectors: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors):
            return _rows(np.zeros(0, np.int64), [], [], True)
        x = np.frombuffer(b"".join(vectors["x"]), np.float32).reshape(len(vectors), -1)
        base = xxhash.xxh3_64_intdigest(str(vectors["shard"].iloc[0])) >> 2  # a number of its own, with room for the pivots'
        h, raw, first = vectors["h"].to_numpy(), vectors["x"].to_numpy(), vectors["first"].to_numpy(bool)
        if not len(of):  # nothing was sampled
            return _rows(np.full(len(x), base), h, raw, True).assign(first=first)
        piv = np.frombuffer(of["pivots"].iloc[0], np.float32).reshape(-1, x.shape[1])
        return pd.concat(list(_placed(x, h, raw, piv, p.near, base, first)))

    return fit, split


def _cut(cells: DataFrame, p: IndexParams) -> tuple[DataFrame, int]:
    """Cut shards of more than twice the aimed size by pivots of their own until none is left; exact counts decide."""
    fit, split = _fit_and_split(p)
    for level in range(p.levels + 1):
        sizes = materialise(cells.groupBy("shard").agg(F.count(F.lit(1)).alias("n")))
        large = materialise(sizes.where(F.col("n") > 2 * p.shard).withColumn("salts", F.ceil(F.col("n") / TASK_VECTORS)))
        n_large = large.count()
        if not n_large:
            return cells, sizes.count()
        rest = join_sized(cells, large.select("shard"), ["shard"], "left_anti", n_large)
        rows = join_sized(cells, large, ["shard"], "inner", n_large)
        if level == p.levels:
            moved = rows.withColumn("shard", F.xxhash64("shard", F.pmod(F.xxhash64("h"), F.ceil(F.col("n") / p.shard)))).select("shard", "h", "x", "first")
            out = materialise(rest.unionByName(moved))
            return out, out.select("shard").distinct().count()
        chance = F.least(F.lit(1.0), PER_PIVOT * F.least(F.lit(p.fanout), F.ceil(F.col("n") / p.shard)) / F.col("n"))

        sample = rows.where(F.pmod(F.xxhash64("h", F.lit(level)), F.lit(1_000_000)) < chance * 1_000_000 + 1)
        pivots = materialise(sample.groupBy("shard").applyInPandas(fit, "shard long, pivots binary, salts long"))

        # Pivots go to every task of their shard, so a task holds TASK_VECTORS vectors and one set of pivots.
        salted = pivots.select("shard", "pivots", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        left = rows.withColumn("salt", F.pmod(F.xxhash64("h", F.lit(-level - 1)), F.col("salts"))).select("shard", "salt", "h", "x", "first")
        moved = left.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInPandas(split, SHARDED)
        after = materialise(rest.unionByName(moved))
        drop(cells)
        cells = after
    raise AssertionError("unreachable")


def similar_pairs(rows: DataFrame, k: int = 5, least: float = 0.7, vec_id: str = "id", vector: str = "embedding", params: IndexParams = IndexParams()) -> DataFrame:
    """a, b (a < b): ids of different rows with cosine >= least, of which one is among the k most similar of the other.

    Ties go to the smaller id. Null ids and unusable vectors (null, empty, another length, values null or no finite
    numbers, all zero) take no part; repeated rows of an id count once, its vectors being equal. Copies of one vector
    have cosine 1. An empty table gives no rows. Other columns, whatever their names, are not read. The graphs are
    approximate: a pair whose vectors meet in no shard, or that no search meets, is missed (recall is measured in tests).
    """
    base = rows.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("id"), F.col(vector).alias("vector"))
    id_kind = dict(base.dtypes)["id"]
    p = params
    sent, shards = shards_of(base, base.count(), p)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("h").sort_values("h", ignore_index=True)
        x = np.frombuffer(b"".join(pdf["x"]), np.float32).reshape(len(pdf), -1)
        h = pdf["h"].to_numpy()
        q, m, s = shard_neighbours(x, k + 2, least, p)
        return pd.DataFrame({"h": h[q], "other": h[m], "sim": s.astype(np.float64)}, columns=["h", "other", "sim"])

    def only_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, x = usable(pdf["vector"], p.dims)
            yield pd.DataFrame({"id": pdf["id"].iloc[at].to_numpy(), "h": _hashes(x)}, columns=["id", "h"])

    # One task per shard or a few: tasks of a size of their own, whatever the collection's.
    near = sent.select("shard", "h", "x").repartition(max(1, min(shards, MOST_PARTITIONS)), "shard").groupBy("shard").applyInPandas(search, "h binary, other binary, sim double")
    near = near.groupBy("h", "other").agg(F.max("sim").alias("sim"))
    # A neighbour in either direction is a candidate of both.
    near = materialise(near.unionByName(near.select(F.col("other").alias("h"), F.col("h").alias("other"), "sim")).groupBy("h", "other").agg(F.max("sim").alias("sim")))
    members = materialise(base.mapInPandas(only_ids, f"id {id_kind}, h binary").distinct())
    heads = members.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("rank") <= k + 1).select("h", "id")
    others = near.join(heads.select(F.col("h").alias("other"), F.col("id").alias("candidate")), "other").select("h", "candidate", "sim")
    own = heads.select("h", F.col("id").alias("candidate"), F.lit(1.0).alias("sim"))
    order = Window.partitionBy("h").orderBy(F.desc("sim"), "candidate")
    best = others.unionByName(own).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    lists = best.groupBy("h").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "candidate"))), lambda c: c["candidate"]).alias("candidates"))
    top = members.join(lists, "h").select("id", F.explode(F.slice(F.filter("candidates", lambda c: c != F.col("id")), 1, k)).alias("candidate"))
    return top.select(F.least("id", "candidate").alias("a"), F.greatest("id", "candidate").alias("b")).distinct()
