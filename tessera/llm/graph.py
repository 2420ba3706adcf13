"""Connected components of an edge table that no task and no driver ever holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, materialise

ROUNDS = 60


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (node, smallest node of its component) of the graph with edges a[i] - b[i]; roots have none."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (before == root).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def contract(edges: DataFrame) -> DataFrame:
    """Each partition's edges as a forest of depth one."""

    def run(batches):
        held_a, held_b, n = [], [], 0
        for batch in batches:
            held_a.append(batch.column(0).to_numpy(zero_copy_only=False))
            held_b.append(batch.column(1).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n > 2_000_000:  # so that a large partition stays small in memory
                a, b = forest(np.concatenate(held_a), np.concatenate(held_b))
                held_a, held_b, n = [a], [b], 0
        if held_a:
            a, b = forest(np.concatenate(held_a), np.concatenate(held_b))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["node", "root"])

    return edges.mapInArrow(run, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """edges: two long columns. Returns (node, root) for each node that isn't the smallest of its component.

    Each round deals the edges by their larger node, contracts each partition to a forest (which hooks the
    other neighbours of a node to its smallest) and then lets each node skip from its parent to its parent's parent. It ends when every
    node has one parent and no parent has one. Nodes never gather at a hot root: edges are dealt by the child."""
    a, b = edges.columns[:2]
    links = edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).filter("node <> root")
    links = materialise(contract(links), "cc-start")
    for _ in range(ROUNDS):
        stars = materialise(contract(links.repartition("node")).distinct(), "cc-stars")
        parents = materialise(stars.groupBy("node").agg(F.min("root").alias("root"), F.count("*").alias("n")), "cc-parents")
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        skipped = materialise(stars.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")).distinct(), "cc-skipped")
        busy = skipped.filter("moved").limit(1).count() or parents.filter("n > 1").limit(1).count()
        done, links = (links, stars, parents), skipped.select("node", "root")
        drop_tables(*done)
        if not busy:
            return links
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
