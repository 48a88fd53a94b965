"""Connected components by contraction, as DataFrame joins.

Every round maps each node to the smallest node next to it (followed by one pointer jump), rewires the
edges to those and drops loops; edges vanish after a few rounds.  The rounds' maps are then composed.
Each round's tables are written to the shared folder, so a lost executor costs one task.  Hubs are joined
through a broadcast of the (bounded) list of hot nodes, so no task holds all edges of one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_keys, join_hot, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: src long, dst long (any direction, repeats and loops allowed; nulls are dropped).

    Returns node, component (the smallest node of its component) for every node that has an edge to
    another one.
    """
    either = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    pairs = materialise(edges.where("src <> dst").select(F.explode(either).alias("e")).select("e.src", "e.dst").distinct(), "cc-edges")
    maps: list[DataFrame] = []
    while total := pairs.count():
        # a node that many are mapped to is next to all of them, so the hot nodes are hot in every join below
        hot = hot_keys(pairs, "src", total)
        near = pairs.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("m"))
        jump = near.select(F.col("node").alias("m"), F.col("m").alias("m2"))
        step = materialise(join_hot(near, jump, "m", hot).select("node", F.col("m2").alias("m")), "cc-step")
        maps.append(step)
        a = step.select(F.col("node").alias("src"), F.col("m").alias("a"))
        b = step.select(F.col("node").alias("dst"), F.col("m").alias("b"))
        rewired = join_hot(join_hot(pairs, a, "src", hot), b, "dst", hot).where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        after = materialise(rewired.distinct(), "cc-edges")
        discard(pairs)
        pairs = after
    if not maps:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).where("false")
    whole = maps[-1]
    for step in reversed(maps[:-1]):
        later = whole.select(F.col("node").alias("m"), F.col("m").alias("m2"))
        composed = materialise(join_hot(step, later, "m", hot_keys(step, "m"), "left").select("node", F.coalesce("m2", "m").alias("m")), "cc-map")
        discard(step, whole)
        whole = composed
    return whole.select("node", F.col("m").alias("component"))


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of numbered nodes in memory: labels after joining the pairs (a, b); the smallest wins."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels after joining the pairs (a, b), and those of the pairs that joined something."""
    kept_a, kept_b = [], []
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b = a[apart], b[apart]
        if not len(a):
            break
        low, high = np.minimum(la, lb)[apart], np.maximum(la, lb)[apart]
        _, first = np.unique(high, return_index=True)  # each label is joined to one smaller label at a time
        kept_a.append(a[first])
        kept_b.append(b[first])
        label = merge_labels(label, low[first], high[first])
    none = np.zeros(0, dtype=np.int64)
    return label, np.concatenate(kept_a or [none]), np.concatenate(kept_b or [none])
