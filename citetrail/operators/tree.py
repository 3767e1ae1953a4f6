"""A scope's citation graph as a tree from its root, as a depth-first walk shows it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def walk(root: str, edges: list[tuple[str, str, str]]) -> list[tuple[int, int, str, str | None, str | None]]:
    """(place, depth, node, edge, parent) in the order of the walk, from edges (id, source, target) in their order.

    When a node is entered, its edges to nodes entered so far are left out; so a node reached twice before it is entered
    is shown twice, the second time with what is then not entered yet.
    """
    below: dict[str, list[tuple[str, str]]] = {}
    for edge, source, target in edges:
        below.setdefault(target, []).append((edge, source))
    out, entered, stack = [], set(), [(root, None, None, 0)]
    while stack:
        node, edge, parent, depth = stack.pop()
        entered.add(node)
        out.append((len(out), depth, node, edge, parent))
        stack.extend((s, e, node, depth + 1) for e, s in reversed([x for x in below.get(node, []) if x[1] not in entered]))
    return out


def source_trees(edges: DataFrame, root: str = "article") -> DataFrame:
    """scope, place, depth, node_id, edge_id, parent_id per scope. edges(scope, edge_id, source, target, seq).

    A tree is one analysis's; an analysis is bounded by its budgets, so a scope is walked in one task.
    """

    def trees(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "edge_id"])
        rows = walk(root, list(zip(pdf["edge_id"], pdf["source"], pdf["target"], strict=True)))
        out = pd.DataFrame(rows, columns=["place", "depth", "node_id", "edge_id", "parent_id"])
        out.insert(0, "scope", pdf["scope"].iloc[0])
        return out

    return edges.select("scope", "edge_id", "source", "target", "seq").groupBy("scope").applyInPandas(trees, "scope string, place int, depth int, node_id string, edge_id string, parent_id string")
