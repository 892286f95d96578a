"""Centrality of small graphs: what built-in functions cannot express."""

from __future__ import annotations

from pyspark.sql import DataFrame


def betweenness(edges: dict[str, set[str]]) -> dict[str, float]:
    """The share of shortest paths between others that pass each vertex of an unweighted graph, of (n - 1)(n - 2) ordered pairs."""
    score, n = dict.fromkeys(edges, 0.0), len(edges)
    for source in edges:
        depth, ways, levels = {source: 0}, {source: 1.0}, [[source]]
        while levels[-1]:
            below = []
            for v in levels[-1]:
                for w in sorted(edges[v]):
                    if w not in depth:
                        depth[w], ways[w] = depth[v] + 1, 0.0
                        below.append(w)
                    if depth[w] == depth[v] + 1:
                        ways[w] += ways[v]
            levels.append(below)
        share = dict.fromkeys(depth, 0.0)
        for level in reversed(levels):
            for w in level:
                for v in edges[w]:
                    if depth.get(v, n) == depth[w] - 1:
                        share[v] += ways[v] / ways[w] * (1 + share[w])
                if w != source:
                    score[w] += share[w]
    return {v: s / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, s in score.items()}


def central(edges: DataFrame, group: str, a: str = "a", b: str = "b") -> DataFrame:
    """group, vertex and betweenness of each group's graph. A group is an ego graph or another cut of bounded size: it meets in one task."""

    def run(pdf):
        import pandas as pd

        near: dict[str, set[str]] = {}
        for x, y in zip(pdf[a], pdf[b], strict=True):
            if x != y:
                near.setdefault(x, set()).add(y)
                near.setdefault(y, set()).add(x)
        got = betweenness(near)
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(got), "vertex": list(got), "betweenness": list(got.values())})

    kinds = dict(edges.dtypes)
    return edges.select(group, a, b).groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, vertex {kinds[a]}, betweenness double")
