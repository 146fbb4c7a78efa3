"""Connected components of an edge table, by alternating large-star and small-star contraction.

Each round points every node at the smallest neighbour; rounds grow with the logarithm of a component's size. The
smallest neighbour is found with partial aggregation, edges of a hot node are split like any skewed join, and each
round's edges are written to the shared folder, so that lineage stays short and no links come to the driver.

An edge table of at most SMALL edges, which is counted first, is contracted in one task with numpy instead: the same
labels, without rounds of shuffles that cost more than they spread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard, tidy


#: Edges that one task may hold (16 bytes each).
SMALL = 1 << 19


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if parts:
            nodes, labels = contract(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], ["node", "label"])

    return edges.coalesce(1).mapInArrow(run, "node long, label long")


def _round(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. Large-star: larger neighbours go to the smallest one; small-star: smaller ones do."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """node, label (the smallest node of its component) for all nodes of links (a, b); a table that discard() takes."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges, before = cut(edges), None
    if edges.count() <= small:
        out = cut(_in_one_task(edges))
        discard(edges)
        return out
    while True:
        with tidy(edges.sparkSession):
            mark = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).head()
        if mark == before:
            break
        after = cut(_round(_round(edges, True), False))
        discard(edges)
        edges, before = after, mark
    tops = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("label"))
    out = cut(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(tops))
    discard(edges)
    return out
