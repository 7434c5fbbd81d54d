"""Connected components of an edge table, without bringing edges to the driver.

What has come is contracted by a local union-find in every task; until what is left is small, rounds of two
steps go on, then one task ends it. In the first step every node points its larger neighbours to the
smallest of its neighbours and itself, in the second its smaller ones and itself: paths halve, and each
component becomes a star around its smallest node. Rounds are written to the shared folder, so a lost
executor repeats one round at most. No row or group grows with a node's degree: minima are combined before
the shuffle, and a node with very many edges is a skewed join, which adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut


STAR = "node long, root long"
#: Edges that one task contracts: 16 bytes each, some 150 MB at work.
EDGES_IN_TASK = 1 << 20


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their component's smallest node, for nodes that are not the smallest."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    left, right = index[: len(a)], index[len(a) :]
    while True:
        low = np.minimum(label[left], label[right])
        fresh = label.copy()
        np.minimum.at(fresh, left, low)
        np.minimum.at(fresh, right, low)
        np.minimum.at(fresh, label[left], low)
        np.minimum.at(fresh, label[right], low)
        while not np.array_equal(fresh[fresh], fresh):
            fresh = fresh[fresh]
        if np.array_equal(fresh, label):
            break
        label = fresh
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def _stars(batches):
    """The edges of a task as stars around the smallest nodes; contracted whenever they have doubled."""
    a, b, most = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1 << 21
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        if sum(map(len, a)) > most:
            x, y = contract(np.concatenate(a), np.concatenate(b))
            a, b, most = [x], [y], max(most, 2 * len(x))
    x, y = contract(np.concatenate(a), np.concatenate(b))
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["node", "root"])


def _pointed(edges: DataFrame, larger: bool) -> DataFrame:
    """One step over edges (node, root), root below node: to the minimum go the larger neighbours, or the
    smaller ones and the node itself."""
    ends = edges.select(F.col("node").alias("u"), F.col("root").alias("v"))
    if larger:
        ends = ends.union(ends.select("v", "u"))
    low = ends.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    if larger:
        moved = ends.where("v > u").join(low, "u").select(F.col("v").alias("node"), F.col("least").alias("root"))
    else:
        moved = ends.join(low, "u").select(F.col("v").alias("node"), F.col("least").alias("root")).union(low.select("u", "least"))
    return moved.where("node <> root").distinct()


def components(edges: DataFrame, in_task: int = EDGES_IN_TASK) -> DataFrame:
    """(node, root) for each node of edges (a, b: long) but the smallest of its component, the root.

    Once the contracted edges fit into one task, that task finishes them; until then rounds go on.
    """
    current = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_stars, STAR), "edges")
    while current.count() > in_task:
        large = cut(_pointed(current, True), "large-stars")
        current = cut(_pointed(large, False).mapInArrow(_stars, STAR).distinct(), "stars")
        single = current.groupBy("node").count().where("count > 1").isEmpty()
        if single and current.join(current.select(F.col("root").alias("node")).distinct(), "node", "left_semi").isEmpty():
            return current
    return cut(current.coalesce(1).mapInArrow(_stars, STAR), "stars")
