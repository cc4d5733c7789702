"""Connected components of a table of edges, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barcast.llm.common import map_lists
from barcast.session import staged

CONTRACT_EDGES = 200_000  # edges that a task joins at once


class Forest:
    """Union-find; the root of a tree is its smallest node."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, node):
        parent = self.parent
        root = node
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(node, node)) != root:
            parent[node], node = root, up
        return root

    def join(self, a, b) -> bool:
        """True where the two were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, at most one per node and task.

    ``edges`` is a stored table; its parts are put together until a task has up to ``CONTRACT_EDGES``, so
    that trees of one component that were found apart collapse here.
    """
    tasks = max(1, ceil(edges.count() / CONTRACT_EDGES))
    edges = edges.coalesce(tasks)

    def work(batches) -> Iterator[list[list]]:
        forest, seen = Forest(), 0

        def out():
            nodes = list(forest.parent)
            return [nodes, [forest.find(n) for n in nodes]]

        for a, b in batches:
            for one, other in zip(a, b):
                forest.join(one, other)
            seen += len(a)
            if seen >= CONTRACT_EDGES:
                yield out()
                forest, seen = Forest(), 0
        yield out()

    kind = edges.schema["a"].dataType.simpleString()
    return map_lists(edges, work, f"a {kind}, b {kind}").where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b) that has an edge; the root is the smallest node.

    Large-star and small-star steps alternate until nothing changes; each
    works by aggregation and joins, so no task needs all neighbours of a node.
    Every round is written to the shared folder.
    """
    found = staged(edges.where("a <> b").select("a", "b"), "links")
    current = staged(contracted(found).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")), "edges")
    before = None
    while True:
        both = current.unionByName(current.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(smallest, "hi")
        small = joined.select("hi", F.col("m").alias("lo")).unionByName(joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        current = staged(small.distinct(), "edges")
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if state == before:
            return current.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        before = state
