"""Texts that are similar by their runs of words, exactly, with little moved.

The sets of runs are many times the texts, so they are never written: each step reads the texts and makes the sets again.

1. Every text gets the size and a hash of its set, and runs are counted in a table of `SLOTS` counters by their hash.
2. Prefix filtering: in an order of runs that is the same for all texts, two similar sets share one of the first few of
   both. Any order gives all pairs; that of the counters puts common runs last. Only these first runs are moved, sorted
   and packed as differences, and meet by ranges of their hashes. Places in the order and sketches of the whole sets
   bound what two can share, so few pairs are left that are not similar.
3. The texts of pairs that met are moved, once for all pairs of a neighbourhood, and compared by their whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citetrail.functions import text
from citetrail.runtime import join_sized, materialise

#: Counters of runs; pieces they are summed in; first runs in a range of hashes; pairs compared by one task; first runs sorted at once.
SLOTS, PIECES, RANGE, COMPARED, CHUNK = 1 << 20, 16, 4_000_000, 20_000, 2_000_000
#: Classes of runs in a sketch; bytes of it: one bit for a run of the class, one for two.
CLASSES = 512
SKETCH = CLASSES // 4
U = np.uint64
_TOKEN = U((1 << 40) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _word_hashes(x: np.ndarray, start: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of signs x, those of words and where words start: the place and the hash of each word of at least so many signs."""
    at, first = np.flatnonzero(inside), np.flatnonzero(start)
    if not len(at):
        return first, np.zeros(0, U)
    begin = np.flatnonzero(start[at])
    length = np.diff(begin, append=len(at))
    power = np.cumprod(np.full(length.max(), 0x9E3779B97F4A7C15, U))
    weight = power[np.arange(len(at)) - np.repeat(begin, length)]
    h = _mix(np.add.reduceat(_mix(x[at].astype(U) + U(0x632BE59BD9B4E019)) * weight, begin) + length.astype(U))
    return first[length >= least], h[length >= least]


_PLAIN = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def word_hashes(column: pa.Array, scripts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of texts in lower case the words of text.plain_words, or with the classes of signs those of text.script_words, as hashes, and where each text's begin."""
    if scripts is None:
        c = column.cast(pa.large_string())
        off = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        x, off = np.frombuffer(c.buffers()[2] or b"", np.uint8)[off[0] : off[-1]], off - off[0]
    else:
        texts = column.to_pylist()
        x, off = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, texts)])
    new = np.zeros(len(x) + 1, bool)
    new[off] = True
    new = new[:-1]
    if scripts is None:
        inside = _PLAIN[x]
        start = inside & (new | ~np.concatenate([[False], inside[:-1]])) if len(x) else inside
    else:
        kind = scripts[x]
        unspaced, mark = kind & 1 > 0, kind & 2 > 0
        # Marks belong to the sign without spaces before them, of the same text.
        last = np.maximum.accumulate(np.where(unspaced | ~mark | new, np.arange(len(x)), 0)) if len(x) else off[:0]
        before = np.concatenate([[0], last[:-1]])[: len(x)]
        joined = mark & ~new & unspaced[before]
        run = (kind & 4 > 0) & ~joined & ~unspaced
        inside = unspaced | joined | run
        start = (unspaced & ~joined) | (run & (new | ~np.concatenate([[False], run[:-1]])[: len(x)]))
    place, h = _word_hashes(x, start, inside, 3 if scripts is None else 1)
    return h, np.searchsorted(place, off)


def script_classes(spark: SparkSession) -> np.ndarray:
    """By code point: 1 in scripts without spaces, 2 a mark, 4 a letter, mark or digit; as the expressions of the session see them."""
    signs = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    kinds = [rf"[^{c}]" for c in (text.UNSPACED, r"\p{M}", r"\p{L}\p{M}\p{N}")]
    found = spark.createDataFrame([(signs,)], "s string").select(*[F.regexp_replace("s", k, " ").alias(f"k{i}") for i, k in enumerate(kinds)]).first()
    at, out = np.frombuffer(signs.encode("utf-32-le"), np.uint32), np.zeros(0x110000, np.uint8)
    for i, f in enumerate(found):
        out[at] |= ((np.frombuffer(f.encode("utf-32-le"), np.uint32) == at) & (at != 32)).astype(np.uint8) << i
    return out


def _sets(column: pa.Array, words: int, scripts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: their different runs of words as hashes and the row of each, and by row the size and the hash of the set."""
    v, off = word_hashes(column, scripts)
    m = np.maximum(np.diff(off) - (words - 1), 0)
    row = np.repeat(np.arange(len(m)), m)
    at = np.arange(len(row)) + (off[:-1] - (np.cumsum(m) - m))[row]
    h = np.zeros(len(row), U)
    for j in range(words):
        h = (h ^ (h >> U(32))) * U(0x9E3779B97F4A7C15) + v[at + j]
    h = _mix(h)
    key = h ^ ((row.astype(U) + U(1)) * U(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    keep = np.ones(len(h), bool)
    keep[order[1:][key[order[1:]] == key[order[:-1]]]] = False
    h, row = h[keep], row[keep]
    n = np.bincount(row, minlength=len(m))
    upto, end = np.concatenate([np.zeros(1, U), np.cumsum(_mix(h + U(0x2545F4914F6CDD1D)))]), np.cumsum(n)
    return h, row, n, _mix(upto[end] - upto[end - n] + n.astype(U))


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, the lowest bytes first, without those that all have as zero."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(b, np.uint8).reshape(-1, n)
    out[:, : len(planes)] = planes.T
    return out.view("<u8")[:, 0]


def _sketches(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    count = np.bincount(row * CLASSES + (h & U(CLASSES - 1)).astype(np.int64), minlength=rows * CLASSES).reshape(rows, CLASSES)
    return np.concatenate([np.packbits(count > 0, axis=1), np.packbits(count > 1, axis=1)], axis=1)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _measured(words: int, scripts: np.ndarray | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, names = np.zeros(SLOTS, np.int64), ["id", "n", "set_hash", "piece", "counts"]
        for b in _slices(batches):
            h, _, n, hashed = _sets(b.column("w"), words, scripts)
            slot, times = np.unique(h >> U(44), return_counts=True)
            count[slot.astype(np.int64)] += times
            hashed = np.where(n > 0, hashed.view(np.int64), b.column("alone").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int32()), pa.array(hashed, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        if count.any():
            for i, part in enumerate(np.split(count, PIECES)):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([i], pa.int32()), pa.array([_planes(part)], pa.binary())], names)

    return run


def _levels(table: pa.Table) -> pa.Table:
    """The counters of a piece as steps of an eighth of a doubling."""
    total = sum(_unplaned(x.as_py(), SLOTS // PIECES).astype(np.float64) for x in table.column("counts"))
    return pa.table({"piece": table.column("piece")[:1], "levels": pa.array([np.minimum(8 * np.log2(total + 1), 255).astype(np.uint8).tobytes()], pa.binary())})


def _first_runs(words: int, scripts: np.ndarray | None, least: float, levels: np.ndarray, ranges: int) -> Callable:
    names, kinds = ["part", "size", "tokens", "docs", "places", "hashes", "sizes", "sketches"], (pa.int32(), pa.int32(), *[pa.binary()] * 6)

    def packed(posts: list[np.ndarray], hashes: list[np.ndarray], sizes: list[np.ndarray], drawn: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        uniq, first, same = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        n, p = np.concatenate(sizes)[first], np.concatenate(posts)
        drawn = np.concatenate(drawn)[first]
        # 40 bits of the run, 16 of the text, 8 of the place.
        p = np.unique(p & ~U(0xFFFF00) | same[(p >> U(8) & U(0xFFFF)).astype(np.int64)].astype(U) << U(8))
        edge = np.searchsorted(p, np.array([((i << 40) // ranges) << 24 for i in range(1, ranges)], U))
        for i, (lo, hi) in enumerate(zip([0, *edge], [*edge, len(p)])):
            if hi > lo:
                docs, code = np.unique((p[lo:hi] >> U(8) & U(0xFFFF)).astype(np.int64), return_inverse=True)
                row = (i, int(hi - lo), _planes(np.diff(p[lo:hi] >> U(24), prepend=U(0))), _planes(code), _planes(p[lo:hi] & U(0xFF)), uniq[docs].tobytes(), _planes(n[docs]), drawn[docs].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posts, hashes, sizes, drawn, rows, held = [], [], [], [], 0, 0
        for b in _slices(batches):
            h, row, n, hashed = _sets(b.column("w"), words, scripts)
            drawn.append(_sketches(h, row, len(n)))
            key = np.sort(row.astype(U) << U(48) | levels[(h >> U(44)).astype(np.int64)].astype(U) << U(40) | h >> U(24))
            row = (key >> U(48)).astype(np.int64)
            place = np.arange(len(key)) - (np.cumsum(n) - n)[row]
            use = place < (n - np.ceil(n * least - 1e-9).astype(np.int64) + 1)[row]
            key, row, place = key[use], row[use], place[use]
            posts.append((key & _TOKEN) << U(24) | (row + rows).astype(U) << U(8) | (place * 255 // n[row]).astype(U))
            hashes.append(hashed)
            sizes.append(n)
            rows, held = rows + len(n), held + len(key)
            if held > CHUNK or rows > 50_000:
                yield from packed(posts, hashes, sizes, drawn)
                posts, hashes, sizes, drawn, rows, held = [], [], [], [], 0, 0
        if held:
            yield from packed(posts, hashes, sizes, drawn)

    return run


def _met(least: float) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        token, doc, place, hashes, sizes, drawn, base = [], [], [], [], [], [], 0
        for r in table.to_pylist():
            hashes.append(np.frombuffer(r["hashes"], "<u8"))
            token.append(np.cumsum(_unplaned(r["tokens"], r["size"])))
            doc.append(_unplaned(r["docs"], r["size"]).astype(np.int64) + base)
            place.append(_unplaned(r["places"], r["size"]).astype(np.uint8))
            sizes.append(_unplaned(r["sizes"], len(hashes[-1])).astype(np.int64))
            drawn.append(np.frombuffer(r["sketches"], "<u8").reshape(len(hashes[-1]), -1))
            base += len(hashes[-1])
        uniq, first, same = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        by_size = np.argsort(np.concatenate(sizes)[first], kind="stable")
        rank = np.empty(len(by_size), np.int64)
        rank[by_size] = np.arange(len(by_size))
        first = first[by_size]
        uniq, n, drawn = uniq[by_size], np.concatenate(sizes)[first].astype(float), np.concatenate(drawn)[first]
        key, place = np.concatenate(token) << U(24) | rank[same[np.concatenate(doc)]].astype(U), np.concatenate(place)
        order = np.lexsort((place, key))
        order = order[np.concatenate([[True], key[order[1:]] != key[order[:-1]]])]  # copies
        t = key[order] >> U(24)
        alone = np.concatenate([[True], t[1:] != t[:-1], [True]])
        order = order[~(alone[1:] & alone[:-1])]
        t, g = key[order] >> U(24), (key[order] & U(0xFFFFFF)).astype(np.int64)
        # The first run two sets share stands where as many still follow as they must share.
        size, share = n[g], least / (1 + least)
        after = size - place[order] * size / 255 + 1e-6
        most = after / share - size
        # From the smaller set to the larger ones after it, further and further, as long as their sizes fit.
        i, d, codes, held = np.arange(len(t)), 1, [np.zeros(0, np.int64)], 0
        while len(i):
            i = i[: np.searchsorted(i, len(t) - d)]
            i = i[(t[i + d] == t[i]) & (size[i + d] <= most[i])]
            x = i[after[i + d] >= share * (size[i] + size[i + d])]
            x, y = g[x], g[x + d]
            if len(x):
                apart = np.concatenate([np.bitwise_count(drawn[x[k : k + 50_000]] ^ drawn[y[k : k + 50_000]]).sum(1, dtype=np.int64) for k in range(0, len(x), 50_000)])
                fits = apart <= (n[x] + n[y]) * (1 - 2 * share) + 1e-6
                x, y = x[fits], y[fits]
            codes.append(x << 32 | y)
            held, d = held + len(x), d + 1
            if held > 4_000_000:
                codes, held = [np.unique(np.concatenate(codes))], 0
        code = np.unique(np.concatenate(codes))
        a, b = uniq[code >> 32].view(np.int64), uniq[code & 0xFFFFFFFF].view(np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _compared(words: int, scripts: np.ndarray | None, least: float) -> Callable:
    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        sets: dict[int, tuple[int, np.ndarray]] = {}
        for b in texts.to_batches(max_chunksize=1_000):
            h, _, n, hashed = _sets(b.column("w"), words, scripts)
            want, ids, end = b.column("set_hash").to_pylist(), b.column("id").to_pylist(), np.cumsum(n)
            for i, x in enumerate(hashed.view(np.int64).tolist()):
                if x == want[i]:  # rows with equal ids may have other texts
                    sets[x] = ids[i], h[end[i] - n[i] : end[i]]
        names, runs = list(sets), [s for _, s in sets.values()]
        place = {x: i for i, x in enumerate(names)}
        _, dense = np.unique(np.concatenate(runs), return_inverse=True)
        runs = np.split(dense, np.cumsum([len(r) for r in runs])[:-1])
        a, b = (np.array([place[x] for x in pairs.column(c).to_pylist()], np.int64) for c in "ab")
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        mark, both = np.zeros(len(dense) + 1, bool), np.zeros(len(a), np.int64)
        edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))
        for lo, hi in zip(edge[:-1], edge[1:]):
            mark[runs[a[lo]]] = True
            for at in range(lo, hi):
                both[at] = np.count_nonzero(mark[runs[b[at]]])
            mark[runs[a[lo]]] = False
        size, ids = np.array([len(r) for r in runs]), np.array([i for i, _ in sets.values()], np.int64)
        jaccard = both / (size[a] + size[b] - both)
        good = jaccard >= least - 1e-12
        x, y = ids[a[good]], ids[b[good]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "jaccard": jaccard[good]})

    return run


def similar_texts(texts: DataFrame, least: float, words: int = 5, all_scripts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Texts with their sets, and the pairs of similar sets.

    texts(id long, text string). Words are those of text.plain_words, or of text.script_words. The first: id, n, set_hash, of every text; n is the size of its set of runs of so many
    words, of the whole text, and equal sets have equal hashes; where n is 0, texts that are equal have,
    and a null text has its own. The second: a, b, jaccard (a < b) of every two different sets with at least this Jaccard
    similarity, each under the least id that has it. Sets without runs match nothing. Rows without an id are left out.
    """
    spark, texts = texts.sparkSession, texts.where("id is not null").select("id", "text")
    scripts, lower = script_classes(spark) if all_scripts else None, F.coalesce(F.lower("text"), F.lit("")).alias("w")
    alone = F.when(F.col("text").isNull(), F.xxhash64(F.lit("id"), "id")).otherwise(F.xxhash64(F.lit("text"), "text")).alias("alone")
    made = materialise(texts.select("id", alone, lower).mapInArrow(_measured(words, scripts), "id long, n int, set_hash long, piece int, counts binary"))
    rows = made.where("piece is null").select("id", "n", "set_hash")
    firsts = rows.where("n > 0").groupBy("set_hash").agg(F.min("id").alias("id"))
    levels = np.zeros((PIECES, SLOTS // PIECES), np.uint8)
    for r in made.where("piece is not null").select("piece", "counts").groupBy("piece").applyInArrow(_levels, "piece int, levels binary").collect():
        levels[r.piece] = np.frombuffer(r.levels, np.uint8)
    total = rows.agg(F.sum("n")).first()[0] or 0
    ranges = int(total * (1 - least)) // RANGE + 3
    posts = texts.where("text is not null").select(lower).mapInArrow(
        _first_runs(words, scripts, least, levels.ravel(), ranges), "part int, size int, tokens binary, docs binary, places binary, hashes binary, sizes binary, sketches binary"
    )
    met = materialise(posts.groupBy("part").applyInArrow(_met(least), "a long, b long").distinct())
    # All pairs of a neighbourhood are compared in one place, so a text is moved about once; very large ones are cut.
    near = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.least(F.min("b"), "a").alias("g"))
    at = met.join(near, "a")
    cut = at.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / (20 * COMPARED)).alias("cuts"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), met.count() // COMPARED + 1)
    at = materialise(at.join(cut, "g").select(F.pmod(F.xxhash64("g", F.pmod(F.xxhash64("a"), F.col("cuts"))), F.lit(buckets)).cast("int").alias("bucket"), "a", "b"))
    ends = at.select("bucket", F.col("a").alias("set_hash")).unionByName(at.select("bucket", F.col("b").alias("set_hash"))).distinct()
    need = materialise(ends.join(firsts, "set_hash"))
    moved = join_sized(texts, need, ["id"]).repartition("bucket").select("bucket", "id", "set_hash", lower)
    pairs = moved.groupBy("bucket").cogroup(at.groupBy("bucket")).applyInArrow(_compared(words, scripts, least), "a long, b long, jaccard double")
    return rows, pairs
