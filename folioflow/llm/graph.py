"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def forest(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each of ``size`` positions over the given pairs."""
    label = np.arange(size)
    while len(left):
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    return label


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, root``: the smallest node reachable from every node that has an edge.

    Each round hooks every node to its smallest smaller neighbour, resolves the hooks to their
    roots by pointer jumping, and contracts the edges to the roots. Nothing is gathered: rounds
    are joins and minima over tables in the shared folder, and only row counts reach the
    driver. A hub's edges meet one row per node, a join that adaptive execution can split.
    Null ends and loops are ignored; an empty table gives an empty result.
    """
    ends = edges.select(F.col(left).alias("a"), F.col(right).alias("b"))
    current = written(_oriented(ends), "graph-edges")
    labels = written(
        current.select(F.col("a").alias("node"))
        .union(current.select(F.col("b").alias("node")))
        .distinct()
        .withColumn("root", F.col("node")),
        "graph-labels",
    )
    while current.limit(1).count():
        hooks = resolved(written(current.groupBy("a").agg(F.min("b").alias("b")), "graph-hooks"))
        to = hooks.select(F.col("a").alias("_from"), F.col("b").alias("_to"))
        labels = written(
            labels.join(to, labels["root"] == to["_from"], "left").select(
                "node", F.coalesce("_to", "root").alias("root")
            ),
            "graph-labels",
        )
        # The larger end of an edge always has a hook.
        moved = current.join(to, current["a"] == to["_from"]).select(
            F.col("_to").alias("a"), "b"
        )
        moved = written(moved.filter("a <> b").distinct(), "graph-moved")
        moved = moved.join(to, moved["b"] == to["_from"], "left").select(
            "a", F.coalesce("_to", "b").alias("b")
        )
        current = written(_oriented(moved), "graph-edges")
    return labels


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller end."""
    return (
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def resolved(hooks: DataFrame) -> DataFrame:
    """Follow ``a -> b`` to its end, doubling the length of the jumps in every round."""
    while True:
        onward = hooks.select(F.col("a").alias("_from"), F.col("b").alias("_to"))
        jumped = written(
            hooks.join(onward, hooks["b"] == onward["_from"], "left").select(
                "a", F.coalesce("_to", "b").alias("b"), F.col("_to").isNotNull().alias("_moved")
            ),
            "graph-jumps",
        )
        if not jumped.filter("_moved").limit(1).count():
            return jumped.drop("_moved")
        hooks = jumped.drop("_moved")
