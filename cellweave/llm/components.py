"""Connected components of an edge table, distributed: alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and the least node that each reaches, in one process."""
    nodes, inverse = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)  # hook the roots
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours linked to the least of them and itself: the larger neighbours in a
    large star, the others and the node itself in a small one."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    out = both.join(least, F.col("u") == F.col("w"))
    if large:
        out = out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``u, v`` (longs) -> ``node, root``: every node of an edge and the least node it reaches.

    Each round is written to the shared folder.  The rounds are logarithmic in the number of
    nodes; hot nodes are never gathered, only aggregated and joined.
    """
    state, last = staged(edges.where(F.col("u") != F.col("v")).distinct(), "edges"), None
    for _ in range(rounds):
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            break
        last = mark
        new = staged(_star(_star(state, large=True), large=False), "edges")
        drop_staged(state)
        state = new
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
