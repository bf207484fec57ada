"""Connected components by repeated contraction, and bounded all-pairs blocks inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a, b long): component is its smallest reachable node.

    Each round every node picks its smallest neighbour (or itself); the picks form a forest whose roots become
    the nodes of the next, at most half as large, graph. Aggregations are partial before they shuffle, and the
    joins have one side unique by key, so a hub is a skewed join that AQE splits, never a group in one task.
    Every step is a written table. Self loops and repeated edges are harmless; no edges give no rows.
    """
    at = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    assign = None
    while True:
        both = at.select("a", "b").union(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        forest = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent")), "forest")
        while True:  # pointer jumping: two jumps a pass
            up = forest.select(F.col("node").alias("u"), F.col("parent").alias("up"))
            top = forest.select(F.col("node").alias("t"), F.col("parent").alias("tp"))
            jumped = materialize(forest.join(up, F.col("parent") == F.col("u")).join(top, F.col("up") == F.col("t")).select("node", F.col("tp").alias("parent"), (F.col("tp") != F.col("parent")).alias("moved")), "forest")
            forest = jumped.select("node", "parent")
            if jumped.where("moved").isEmpty():
                break
        assign = forest.select("node", F.col("parent").alias("component")) if assign is None else materialize(
            assign.join(forest.select(F.col("node").alias("c"), "parent"), F.col("component") == F.col("c"), "left").select("node", F.coalesce("parent", "component").alias("component")), "assign")
        pa_ = forest.select(F.col("node").alias("na"), F.col("parent").alias("ra"))
        pb_ = forest.select(F.col("node").alias("nb"), F.col("parent").alias("rb"))
        at = materialize(at.join(pa_, F.col("a") == F.col("na")).join(pb_, F.col("b") == F.col("nb")).where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if at.isEmpty():
            return assign


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links (i, j); vectorised label spreading."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        keep = root[i] != root[j]
        i, j = i[keep], j[keep]
    return root


def group_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours in sorted keys."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return start, np.diff(np.concatenate([start, [len(keys)]]))


def run_pairs(start: np.ndarray, length: np.ndarray, most: int = 1 << 21):
    """All index pairs (i < j) inside each run, vectorised by run length, at most about ``most`` pairs at once."""
    for n in np.unique(length):
        n = int(n)
        if n < 2:
            continue
        at = start[length == n]
        if n <= 256:
            i, j = np.triu_indices(n, 1)
            step = max(1, most // len(i))
            for k in range(0, len(at), step):
                base = at[k : k + step, None]
                yield (base + i).ravel(), (base + j).ravel()
        else:
            rows = max(1, most // n)
            for s in at:
                for r in range(0, n, rows):
                    i, j = np.meshgrid(np.arange(r, min(r + rows, n)), np.arange(n), indexing="ij")
                    keep = i < j
                    yield s + i[keep], s + j[keep]
