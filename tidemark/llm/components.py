"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, dropped, saved

#: Edges that a task folds into a forest at once; bounds its memory.
FOLD_EDGES = 500_000
#: Edges, some 300 bytes each in Python, that one task folds to the end; more go on in rounds.
LAST_EDGES = 100_000


def forest(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its tree) for every node that is not its own root."""
    root: dict[int, int] = {}

    def find(x):
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x] = top
            x = up
        return top

    for a, b in pairs:
        root.setdefault(a, a)
        root.setdefault(b, b)
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, top) for x in root if (top := find(x)) != x]


def _fold(edges: DataFrame) -> DataFrame:
    """Edges with the same components, a spanning forest for each task's share."""

    def rows(found):
        return pa.RecordBatch.from_pydict(
            {"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())}
        )

    def run(batches):
        held = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if len(held) > FOLD_EDGES:
                smaller = forest(held)
                if len(smaller) > FOLD_EDGES // 2:
                    yield rows(smaller)
                    smaller = []
                held = smaller
        yield rows(forest(held))

    return arrow_map(edges, run, "u long, v long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node that it reaches.

    ``edges`` has long columns u and v. Every join key may be hot: aggregations are pre-aggregated and
    written before they are joined, so that both sides of a join have a shuffle of their own and adaptive
    execution can split a hot key. Each round's edges are written to the shared folder, so a lost executor
    costs one round at most. Once LAST_EDGES or fewer are left, one task of bounded size folds them to the end.
    Empty edges give an empty table.
    """

    def star(edges, larger):
        """Link neighbours to the smallest node around: the larger ones, or else the smaller ones."""
        if larger:
            near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = saved(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        helpers.append(least)
        joined = near.join(least, "u")
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if larger else joined.select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    def state(edges):
        return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    helpers: list[DataFrame] = []
    edges = saved(_fold(edges.where("u != v")))
    seen = state(edges)
    for _ in range(rounds):
        if seen[0] <= LAST_EDGES:
            old, edges = edges, saved(_fold(edges.coalesce(1))) if seen[0] else edges
            if old is not edges:
                dropped(old)
            break
        old, edges = edges, saved(star(star(edges, True), False))
        for done in (old, *helpers):
            dropped(done)
        helpers.clear()
        before, seen = seen, state(edges)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
