"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.store import drop, kept


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one edge a value, (value, smallest value it reaches), with the reach of the given edges."""
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = np.split(index, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        np.minimum.at(label, before, label.copy())
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b) other than the root, the smallest node it reaches.

    Each round sends every node to its smallest neighbour. Minima are aggregated before the shuffle and joined
    back, so a node with very many edges is split like any skewed join. Rounds grow with the logarithm of the
    longest path; each is written out, so lineage stays short. An empty edge table gives no rows.
    """
    edges = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        after = kept(small, "edges")
        drop(edges)
        edges = after
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
