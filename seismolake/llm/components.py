"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, split_join, written

#: Edges that a task contracts at once.
GATHER = 1_000_000


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their smallest node reachable by these edges, for the nodes that aren't that themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        for side in (left, right):
            np.minimum.at(root, root[side], low)
            np.minimum.at(root, side, low)
        root = root[root]
        if (root == before).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[root[moved]], nodes[moved]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, with the same components: each task turns what it holds into stars around the smallest node."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += len(batch)
            if n >= GATHER:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    def stars(held):
        a, b = local_roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return written(edges.mapInArrow(lean(run), "a long, b long"), "components")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node), for the nodes of edges (a, b).

    Tasks first contract the edges that they hold. Then, in rounds, every group hooks to a neighbour, follows the hooks a few steps, and the edges between the groups that are left are
    contracted again. Odd rounds hook to the smallest neighbour, which ends stars; even rounds to that of least hash, so long chains of rising nodes end too. Edges and groups stay distributed.
    """
    edges = contracted(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = written(nodes.select("node", F.col("node").alias("group")), "components")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if turn % 2:
            hook = both.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("near")).select("of", F.least("near", "of").alias("to"))
        else:
            ranked = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), c).alias("rank"), F.col(c).alias("to"))
            hook = both.groupBy(F.col("a").alias("of")).agg(F.min(ranked("b")).alias("near")).select("of", F.least("near", ranked("of"))["to"].alias("to"))
        hook = written(hook, "components")
        step = hook.select(F.col("of").alias("via"), F.col("to").alias("beyond"))
        hook = written(hook.join(step, F.col("to") == F.col("via")).select("of", F.col("beyond").alias("to")), "components")
        labels = written(labels.join(hook, F.col("group") == F.col("of"), "left").select("node", F.coalesce("to", "group").alias("group")), "components")
        end = lambda side: hook.select(F.col("of").alias(f"of_{side}"), F.col("to").alias(f"to_{side}"))
        moved = edges.join(end("a"), F.col("a") == F.col("of_a")).join(end("b"), F.col("b") == F.col("of_b")).filter("to_a <> to_b")
        edges = contracted(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    least = written(labels.groupBy(F.col("group").alias("of_group")).agg(F.min("node").alias("component"), F.count("*").alias("size")), "components")
    return split_join(labels, least, "group", "of_group", "size", "node").select("node", "component")
