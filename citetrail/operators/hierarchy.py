"""Parent-child links to full hierarchies (problem 4).

Frontiers are joined with links level by level from the roots, which extends depths and paths; pairs of ancestors yield
descendants. A node met again, or met from no root, reveals cycles.

A scope of at most TASK_ROWS rows is a small graph: its rows move once, to one task, which joins its frontiers there.
A larger scope is joined over the whole cluster. There a node with one parent cannot be met twice from a root, so only
nodes with several are compared with what is known, and every other row moves once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetrail.runtime import Growing, drop, join_sized, materialise, node_key

#: Rows of one scope up to which one task takes all of it; larger scopes are joined in parallel.
TASK_ROWS = 200_000
#: Rows a task gathers before it hands them on.
CHUNK = 50_000

Kids = dict[str, list[str]]


def ends_of(rows: DataFrame, scope: str = "analysis_id", child: str = "source_node_id", parent: str = "target_node_id") -> DataFrame:
    """scope, child, parent: the links whose ends are neither null nor blank, trimmed and in lower case; null scopes are one scope."""
    return rows.select(F.coalesce(F.col(scope), F.lit("")).alias("scope"), node_key(child).alias("child"), node_key(parent).alias("parent")).where("child <> '' and parent <> ''")


def _split(ends: DataFrame, solve: Callable[[list[tuple[str, str]]], Iterator[tuple]], large: Callable[[DataFrame], DataFrame], schema: str, task_rows: int) -> DataFrame:
    """Small scopes through `solve` (distinct (child, parent) of one scope to rows without the scope), large ones through `large` (distinct links)."""
    sizes = ends.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    big = materialise(sizes.where(F.col("n") > task_rows).select("scope"))
    n_big = big.count()  # at most rows / task_rows
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        scope, links = None, set()

        def done() -> Iterator[pd.DataFrame]:
            for row in solve(sorted(links)):
                out.append((scope, *row))
                if len(out) >= CHUNK:
                    yield pd.DataFrame(out, columns=names)
                    out.clear()

        for pdf in batches:
            for s, c, p in zip(pdf["scope"], pdf["child"], pdf["parent"], strict=True):
                if s != scope:
                    yield from done()
                    scope, links = s, set()
                links.add((c, p))
        yield from done()
        yield pd.DataFrame(out, columns=names)

    few = ends if not n_big else join_sized(ends, big, ["scope"], "left_anti", n_big)
    found = few.repartition("scope").sortWithinPartitions("scope").mapInPandas(run, schema)
    if not n_big:
        return found
    return found.unionByName(large(materialise(join_sized(ends, big, ["scope"], "left_semi", n_big).distinct())))


def _kids(links: list[tuple[str, str]]) -> tuple[Kids, list[str]]:
    """Children by parent, and the roots: parents that are no child."""
    kids: Kids = {}
    for c, p in links:
        kids.setdefault(p, []).append(c)
    below = {c for c, _ in links}
    return kids, [p for p in kids if p not in below]


def _levels(kids: Kids, start: str) -> Iterator[tuple[int, list[str]]]:
    """The nodes first met at each level below a node; the node itself is met again only over a cycle."""
    seen: set[str] = set()
    level, depth = [start], 0
    while level:
        depth += 1
        after = []
        for node in level:
            for k in kids.get(node, ()):
                if k not in seen:
                    seen.add(k)
                    after.append(k)
        if after:
            yield depth, after
        level = after


def _reach_in_task(links: list[tuple[str, str]]) -> Iterator[tuple[str, str, int]]:
    kids, roots = _kids(links)
    met = set()
    again = not roots
    for root in roots:
        yield root, root, 0
        met.add(root)
        for depth, level in _levels(kids, root):
            met.update(level)
            for node in level:
                yield node, root, depth
    again = again or any(p not in met for p in kids) or not _falls(kids, links)
    if again:
        for node in _cyclic_in_task(links):
            yield node, "(cycle)", -1


def _falls(kids: Kids, links: list[tuple[str, str]]) -> bool:
    """Whether taking away nodes without parents, level by level, takes away all: then there is no cycle."""
    parents: dict[str, int] = {}
    for c, _ in links:
        parents[c] = parents.get(c, 0) + 1
    level, gone = [p for p in kids if p not in parents], 0
    while level:
        after = []
        for p in level:
            for c in kids.get(p, ()):
                gone += 1
                parents[c] -= 1
                if not parents[c]:
                    after.append(c)
        level = after
    return gone == len(links)


def _cyclic_in_task(links: list[tuple[str, str]]) -> list[str]:
    """Nodes on cycles: strongly connected parts of two nodes or more, and nodes linked to themselves."""
    ids = sorted({x for link in links for x in link})
    place = {x: i for i, x in enumerate(ids)}
    kids: list[list[int]] = [[] for _ in ids]
    hit = set()
    for c, p in links:
        kids[place[p]].append(place[c])
        if p == c:
            hit.add(place[p])
    order, low, on, stack, n = [-1] * len(ids), [0] * len(ids), [False] * len(ids), [], 0
    for start in range(len(ids)):
        if order[start] >= 0:
            continue
        order[start] = low[start] = n
        n += 1
        stack.append(start)
        on[start] = True
        work = [(start, iter(kids[start]))]
        while work:
            v, it = work[-1]
            for w in it:
                if order[w] < 0:
                    order[w] = low[w] = n
                    n += 1
                    stack.append(w)
                    on[w] = True
                    work.append((w, iter(kids[w])))
                    break
                if on[w]:
                    low[v] = min(low[v], order[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on[w] = False
                        part.append(w)
                        if w == v:
                            break
                    if len(part) > 1:
                        hit.update(part)
    return [ids[i] for i in sorted(hit)]


def _paths_in_task(links: list[tuple[str, str]]) -> Iterator[tuple[str, str, int, str]]:
    kids, roots = _kids(links)
    for root in roots:
        seen, level, depth = {root}, {root: root}, 0
        while level:
            for node, path in level.items():
                yield node, root, depth, path
            up: dict[str, str] = {}
            for p in sorted(level):  # the least parent comes first
                for k in kids.get(p, ()):
                    if k not in seen and k not in up:
                        up[k] = p
            seen.update(up)
            level = {k: f"{level[p]}/{k}" for k, p in up.items()}
            depth += 1


def _descend_in_task(links: list[tuple[str, str]]) -> Iterator[tuple[str, str, int]]:
    kids, _ = _kids(links)
    for node in kids:
        for depth, level in _levels(kids, node):
            for k in level:
                yield node, k, depth


class _Met:
    """Rows (scope, node, start, depth) met so far; those of nodes with several parents are kept apart, to be looked up."""

    def __init__(self, first: DataFrame) -> None:
        self.all = Growing(first, by="merge")

    def add(self, found: DataFrame) -> DataFrame:
        """Write what is new of `found`, and return it. Nodes with one parent are met once, so only the others are compared."""
        key = ["scope", "node", "start"]
        merging = found.where("merge").groupBy(*key).agg(F.min("depth").alias("depth"))
        new = merging.join(self.all.read().where("merge").select(*key), key, "left_anti").withColumn("merge", F.lit(True))
        return self.all.add(found.where("not merge").unionByName(new, allowMissingColumns=True).select(*key, "depth", "merge"))


def _steps(links: DataFrame) -> DataFrame:
    """scope, node, child, merge: links from parent to child, with whether the child has several parents."""
    several = links.groupBy("scope", "child").agg((F.count(F.lit(1)) > 1).alias("merge"))
    return materialise(links.join(several, ["scope", "child"]).select("scope", F.col("parent").alias("node"), "child", "merge"))


def _frontiers(first: DataFrame, steps: DataFrame) -> DataFrame:
    """scope, node, start, depth: from (scope, node, start) rows of depth `depth` on, all that links lead to, each once at its least depth."""
    met = _Met(first)
    frontier = met.all.read()
    while not frontier.isEmpty():
        # A start met again over a cycle leads to nothing new, so a node with one parent is met once.
        at = frontier.where("node <> start or depth = 0").select("scope", "node", "start", "depth").join(steps, ["scope", "node"])
        frontier = met.add(at.select("scope", F.col("child").alias("node"), "start", (F.col("depth") + 1).alias("depth"), "merge"))
    return met.all.read().select("scope", "node", "start", "depth")


def reach_from_roots(links: DataFrame) -> DataFrame:
    """scope, node, root, depth: for every node and every root that reaches it, the fewest links between them (a root: 0).

    `links` are distinct. Roots are nodes that are never a child. Nodes that no root reaches have no row. Empty links give no rows.
    """
    roots = links.select("scope", F.col("parent").alias("node")).distinct().join(links.select("scope", F.col("child").alias("node")).distinct(), ["scope", "node"], "left_anti")
    first = roots.select("scope", "node", F.col("node").alias("start"), F.lit(0).alias("depth"), F.lit(False).alias("merge"))
    return _frontiers(first, _steps(links)).withColumnRenamed("start", "root")


def _peel(core: DataFrame) -> DataFrame:
    """Links whose parent is a child of some link and whose child is a parent of some link."""
    heads = core.select("scope", F.col("child").alias("parent")).distinct()
    tails = core.select("scope", F.col("parent").alias("child")).distinct()
    return core.join(heads, ["scope", "parent"], "left_semi").join(tails, ["scope", "child"], "left_semi").select("scope", "child", "parent")


def _spread(start: DataFrame, step: DataFrame, value: str) -> DataFrame:
    """The greatest `value` that reaches each (scope, node) along step(scope, node, to), to a fixed point; only what changed last moves on."""
    state = materialise(start.withColumn("changed", F.lit(True)))
    while True:
        moved = state.where("changed").join(step, ["scope", "node"]).select("scope", F.col("to").alias("node"), value, F.lit(None).cast(dict(start.dtypes)[value]).alias("was"))
        held = state.select("scope", "node", value, F.col(value).alias("was"))
        best = held.unionByName(moved).groupBy("scope", "node").agg(F.max(value).alias(value), F.max("was").alias("was"))
        new = materialise(best.select("scope", "node", value, (F.col("was").isNull() | (F.col(value) > F.col("was"))).alias("changed")))
        drop(state)
        state = new
        if state.where("changed").isEmpty():
            return state.drop("changed")


def _cyclic_by_colours(links: DataFrame) -> DataFrame:
    """scope, node on cycles, in parallel: colour nodes by the greatest node that reaches them; those of a colour that lead back to its greatest node share a cycle with it."""
    out = links.where("child = parent").select("scope", F.col("child").alias("node"))
    core = materialise(links)
    while not core.isEmpty():
        nodes = core.select("scope", F.col("parent").alias("node")).unionByName(core.select("scope", F.col("child").alias("node"))).distinct()
        colour = _spread(nodes.withColumn("colour", F.col("node")), core.select("scope", F.col("parent").alias("node"), F.col("child").alias("to")), "colour")
        inside = core.join(colour.select("scope", F.col("node").alias("parent"), F.col("colour").alias("c1")), ["scope", "parent"]).join(
            colour.select("scope", F.col("node").alias("child"), F.col("colour").alias("c2")), ["scope", "child"]
        )
        inside = materialise(inside.where("c1 = c2").select("scope", "child", "parent"))
        tops = colour.where("node = colour").withColumn("hit", F.lit(1)).select("scope", "node", "hit")
        back = _spread(tops, inside.select("scope", F.col("child").alias("node"), F.col("parent").alias("to")), "hit")
        part = materialise(back.join(colour, ["scope", "node"]))
        several = part.groupBy("scope", "colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionByName(part.join(several, ["scope", "colour"], "left_semi").select("scope", "node"))
        rest = inside.join(part.select("scope", F.col("node").alias("parent")), ["scope", "parent"], "left_anti").join(part.select("scope", F.col("node").alias("child")), ["scope", "child"], "left_anti")
        core = materialise(_peel(rest.select("scope", "child", "parent")))
    return out.distinct()


def nodes_on_cycles(links: DataFrame, reach: DataFrame) -> DataFrame:
    """scope, node: every node that reaches itself over one or more links.

    `reach` is the result of `reach_from_roots`. A scope in which each link leads one level deeper for every root, and
    whose nodes are all reached, has no cycle and is left out. Empty links give no rows.
    """
    near = reach.select("scope", F.col("node").alias("parent"), "root", F.col("depth").alias("d1"))
    far = reach.select("scope", F.col("node").alias("child"), "root", F.col("depth").alias("d2"))
    flat = links.join(near, ["scope", "parent"]).join(far, ["scope", "child", "root"]).where("d2 <= d1").select("scope")
    unreached = links.join(reach.select("scope", F.col("node").alias("parent")).distinct(), ["scope", "parent"], "left_anti").select("scope")
    core = materialise(links.join(flat.unionByName(unreached).distinct(), ["scope"], "left_semi"))
    before = core.count()
    while before:
        peeled = materialise(_peel(_peel(core)))
        drop(core)
        core, after = peeled, peeled.count()
        if after > 0.8 * before:
            break
        before = after
    return _cyclic_by_colours(core)


def _large_hierarchy(links: DataFrame) -> DataFrame:
    reach = reach_from_roots(links)
    cyclic = nodes_on_cycles(links, reach)
    return reach.unionByName(cyclic.select("scope", "node", F.lit("(cycle)").alias("root"), F.lit(-1).alias("depth")))


def hierarchy(rows: DataFrame, scope: str = "analysis_id", child: str = "source_node_id", parent: str = "target_node_id", task_rows: int = TASK_ROWS) -> DataFrame:
    """scope, node, root, depth: for every node and every root that reaches it, the fewest links between them, and for each node on a cycle a row with root `(cycle)` and depth -1.

    Links with a null or blank end are left out; repeated links count once; a link of a node to itself is a cycle. No
    links give no rows. Columns other than the three named are not read.
    """
    return _split(ends_of(rows, scope, child, parent), _reach_in_task, _large_hierarchy, "scope string, node string, root string, depth int", task_rows)


def _large_paths(links: DataFrame) -> DataFrame:
    reach = materialise(reach_from_roots(links))
    step = links.select("scope", F.col("parent").alias("up"), F.col("child").alias("node"))
    up = reach.select("scope", F.col("node").alias("up"), "root", (F.col("depth") + 1).alias("depth"))
    via = materialise(reach.join(step, ["scope", "node"]).join(up, ["scope", "up", "root", "depth"]).groupBy("scope", "node", "root", "depth").agg(F.min("up").alias("up")), by="depth")
    paths = Growing(reach.where("depth = 0").select("scope", "node", "root", "depth", F.col("node").alias("path")))
    level, d = paths.read(), 0
    while not level.isEmpty():
        d += 1
        above = level.select("scope", F.col("node").alias("up"), "root", F.col("path").alias("above"))
        level = paths.add(via.where(F.col("depth") == d).join(above, ["scope", "up", "root"]).select("scope", "node", "root", "depth", F.concat_ws("/", "above", "node").alias("path")))
    return paths.read()


def paths_from_roots(rows: DataFrame, scope: str = "analysis_id", child: str = "source_node_id", parent: str = "target_node_id", task_rows: int = TASK_ROWS) -> DataFrame:
    """scope, node, root, depth, path: a shortest path from each root to each node it reaches, of equal ones the least by its last steps, as `root/.../node`. Links as in `hierarchy`."""
    return _split(ends_of(rows, scope, child, parent), _paths_in_task, _large_paths, "scope string, node string, root string, depth int, path string", task_rows)


def _large_descendants(links: DataFrame) -> DataFrame:
    steps = _steps(links)
    first = steps.select("scope", F.col("child").alias("node"), F.col("node").alias("start"), F.lit(1).alias("depth"), "merge")
    return _frontiers(first, steps).select("scope", F.col("start").alias("node"), F.col("node").alias("descendant"), "depth")


def descendants(rows: DataFrame, scope: str = "analysis_id", child: str = "source_node_id", parent: str = "target_node_id", task_rows: int = TASK_ROWS) -> DataFrame:
    """scope, node, descendant, depth: every ancestor-descendant pair with the fewest links between them (a node on a cycle descends from itself). Links as in `hierarchy`."""
    return _split(ends_of(rows, scope, child, parent), _descend_in_task, _large_descendants, "scope string, node string, descendant string, depth int", task_rows)
