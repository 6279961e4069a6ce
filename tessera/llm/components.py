"""Connected components of a graph whose edges stay distributed.

A graph of at most ``ONE_TASK`` distinct edges, counted first, is solved
over arrays in a single task, whose memory that number bounds. A larger one takes
alternating large-star and small-star steps: a pre-aggregated minimum per node and
a join of the edges with it. Minima are written before they are joined, so both
sides of that join are plain shuffles and a node with very many neighbours is
split by adaptive execution. Every round is written to the shared scratch folder.
Both ways give the same labels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import Scratch

#: Edges that one task may hold: 16 bytes each on the way, some hundred in its arrays.
ONE_TASK = 1 << 20


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, label of each): roots hook on to smaller ones, at least half of those of a component in a round."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        one, two = label[a], label[b]
        apart = one != two
        if not apart.any():
            return nodes, nodes[label]
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(label, up := label[label]):
            label = up


def solve(edges: DataFrame) -> DataFrame:
    """(node, label) in one task, over arrays of some 100 bytes an edge in all."""

    def run(batches):
        import pyarrow as pa

        parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if not parts:
            return
        nodes, labels = smallest(*(np.concatenate(side) for side in zip(*parts)))
        nodes, labels = nodes[nodes != labels], labels[nodes != labels]
        for at in range(0, len(nodes), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 65536], pa.int64()) for x in (nodes, labels)], names=["node", "label"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, label long")


def connected_components(edges: DataFrame, scratch: Scratch, name: str, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """(node, label): the smallest node of its component for every node but that one.

    Self loops, repeated edges and either direction are allowed; edges with a null
    end are left out. The label of a node that is missing here is the node itself.
    """
    edges = edges.filter(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}")
    now = scratch.save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), f"{name}-0")
    if now.count() <= one_task:
        return scratch.save(solve(now), f"{name}-labels")
    seen, n = None, 0
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen, n = mark, n + 1
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), f"{name}-{n}-large")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.save(large, f"{name}-{n}-edges")
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{n}-small")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{n}")
        scratch.drop(f"{name}-{n}-large", f"{name}-{n}-edges", f"{name}-{n}-small", f"{name}-{n - 1}")
