"""Connected components, inside a task and across the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, remove


def merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> int:
    """Join the components of u[i] and v[i] in ``label`` (node -> least node of its component).
    Returns how many labels were joined to others."""
    joined = 0
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return joined
        low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        np.minimum.at(label, high, low)
        joined += len(np.unique(high))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def forest(label: np.ndarray, fan: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Edges that hold each component together, as trees in which no node has many neighbours."""
    order = np.argsort(label, kind="stable")
    of = label[order]
    start = np.flatnonzero(np.diff(of, prepend=-1))
    place = np.arange(len(of)) - np.repeat(start, np.diff(start, append=len(of)))
    child = np.flatnonzero(place > 0)
    parent = child - place[child] + (place[child] - 1) // fan
    return order[parent], order[child]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node of an edge: label is the least node reachable.

    Rounds of taking the least label next door, then the label's own label, until a
    round changes nothing. Every round is a table in the shared folder. Self-loops
    and repeated edges do no harm; null ends are dropped.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both, both_path = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, path = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        one = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        two = one.join(up, one["label"] == up["n2"]).select("node", "was", F.least("label", "l2").alias("label"))
        new, new_path = materialize(two, "labels")
        changed = new.where("label <> was").limit(1).count()
        remove(spark, path)
        labels, path = new.select("node", "label"), new_path
        if not changed:
            remove(spark, both_path)
            return labels
