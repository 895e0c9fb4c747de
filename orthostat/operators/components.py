"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut

#: Edge tables of up to so many rows are solved by union-find in one task.
ONE_TASK_EDGES = 200_000


def find(parent: dict, node):
    """Root of ``node`` in a union-find forest, halving the path."""
    while (up := parent.setdefault(node, node)) != node:
        parent[node] = node = parent[up]
    return node


def union(parent: dict, a, b) -> None:
    """Join two trees; the smaller root stays root."""
    a, b = find(parent, a), find(parent, b)
    if a != b:
        parent[max(a, b)] = min(a, b)


def _one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict = {}
    for batch in batches:
        for a, b in zip(batch["node"], batch["root"]):
            union(parent, a, b)
    nodes = list(parent)
    yield pd.DataFrame({"node": pd.Series(nodes, dtype=object), "root": pd.Series([find(parent, n) for n in nodes], dtype=object)})


def connected_components(edges: DataFrame, a: str, b: str, one_task_edges: int = ONE_TASK_EDGES, max_rounds: int = 60) -> DataFrame:
    """(node, root): each node of a string edge table with the smallest node of its component.

    Nodes without edge, loops and edges with a null end don't appear. Nodes of high degree are
    no bottleneck: neighbourhoods are only ever reduced to their minimum, never collected.
    """
    x, y = F.col(a).cast("string"), F.col(b).cast("string")
    pairs = edges.select(F.greatest(x, y).alias("node"), F.least(x, y).alias("root")).where(x.isNotNull() & y.isNotNull() & (x != y))
    now = cut(pairs.distinct(), "edges")
    if now.count() <= one_task_edges:
        return cut(now.coalesce(1).mapInPandas(_one_task, "node string, root string"), "components")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())

    before = mark(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.first("node")).alias("m"))
        large = both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).distinct()
        large = cut(large, "large")
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(least, "node").select(F.explode(F.array(F.struct("root", "m"), F.struct(F.col("node").alias("root"), "m"))).alias("e"))
        now = cut(small.select(F.col("e.root").alias("node"), F.col("e.m").alias("root")).where("node > root").distinct(), "small")
        after = mark(now)
        if after == before:
            roots = now.select(F.col("root").alias("node"), "root").distinct()
            return now.unionByName(roots)
        before = after
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
