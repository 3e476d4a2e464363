"""Connected components of a graph given as edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, in_workers


def _forest(whole: bool):
    """Of the edges in one partition: each node and the smallest node that it reaches there. whole: each of those nodes too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (above := up.get(top, top)) != top:
                top = above
            while (above := up.get(x, x)) != top and above != x:
                up[x], x = top, above
            return top

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = list(up)
        if whole:
            nodes += {root(x) for x in nodes}
        for at in range(0, len(nodes), 100_000):
            some = nodes[at : at + 100_000]
            yield pa.RecordBatch.from_pydict({"v": pa.array(some, pa.int64()), "r": pa.array([root(x) for x in some], pa.int64())})

    return run


def stars_of(near: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the graph whose symmetric adjacency matrix is near: the id of each row that is no root, and of its root."""
    busy = np.flatnonzero(near.any(1))
    near, ids = near[np.ix_(busy, busy)], ids[busy]
    top = np.arange(len(ids))
    while len(ids):
        after = np.minimum(top, np.where(near, top[None, :], len(ids)).min(1))
        after = np.minimum(after, after[after])
        if np.array_equal(after, top):
            break
        top = after
    own = top != np.arange(len(ids))
    return ids[own], ids[top[own]]


#: Edges (two numbers each) that one task may take, once they have been counted.
ONE_TASK = 1 << 20


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 40, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of every node of edges (a, b), a written table; component is the smallest node it is linked with, directly or not.

    Each round contracts the edges of every partition to a forest of stars, then points each node and all its
    roots at the root of the smallest of them, which halves the height of what is left. It ends when each node has one
    root and no root has another, or when what is left is counted to be few enough for one task, whose forest is
    the answer. No edge list leaves the executors. edges is read twice, so it should be a written table.
    """
    schema = "v long, r long"
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b")
    last = None
    for k in range(rounds):
        if edges.count() <= one_task:
            named = scratch.keep(edges.coalesce(1).transform(in_workers, _forest(True), schema).toDF("node", "component"), name, as_it_is=True)
            break
        stars = scratch.keep(edges.transform(in_workers, _forest(False), schema), f"{name}-{k}")
        if last:
            scratch.drop(last)
        last = f"{name}-{k}"
        least = stars.groupBy("v").agg(F.min("r").alias("m"), F.count_distinct("r").alias("n"))
        if least.where("n > 1").isEmpty() and stars.join(stars.select(F.col("v").alias("r")), "r", "left_semi").isEmpty():
            named = stars.select(F.col("v").alias("node"), F.col("r").alias("component")).distinct()
            named = scratch.keep(named.union(stars.select(F.col("r").alias("node"), F.col("r").alias("component")).distinct()), name)
            break
        least = least.select("v", "m")
        above = least.select(F.col("v").alias("m"), F.col("m").alias("above"))
        least = least.join(above, "m", "left").select("v", F.coalesce("above", "m").alias("m"))
        joined = stars.join(least, "v")
        edges = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(joined.select(F.col("r").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()
        edges = scratch.keep(edges, f"{name}-edges-{k}")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    for other in [x for x in scratch.names if x.startswith(f"{name}-")]:
        scratch.drop(other)
    return named
