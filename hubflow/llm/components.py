"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.llm.common import cut

#: Edges of which one task makes a forest.
MOST = 1 << 20


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free hash of an edge table: equal when a round changed nothing."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each node that has an edge to another node, with the smallest node that it reaches.

    Returns ``node, root``; loops and repeated edges are ignored, an empty input gives no rows. A node's edges never
    meet in one task: its smallest neighbour is found with partial sums, and the join back is one that Spark can split.
    Each round is cut in the checkpoint folder, so a lost executor costs one round at most; a round's table goes once
    the next is written.
    """
    x, y = F.col(a), F.col(b)
    e = cut(edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    before = _mark(e)
    while before[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), instead_of=e)
        after = _mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def thinned(edges: DataFrame, most: int = MOST) -> DataFrame:
    """Edges ``a, b`` that connect what the given ones connect: a forest for each ``most`` edges, made by one task each."""
    e = cut(edges)
    parts = max(1, -(-e.count() // most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*[[b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")] for b in batches], strict=True)]
        if pairs:
            known, ends = np.unique(np.concatenate(pairs), return_inverse=True)
            links = np.array(local_forest(len(known), ends[: len(pairs[0])], ends[len(pairs[0]) :]), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(known[links[:, k]], pa.int64()) for k in (0, 1)], ["a", "b"])

    return e.select("a", "b").repartition(parts).mapInArrow(run, "a long, b long")


def local_forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the given ones connect, fewer than n of them."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    label, out = np.arange(n), []
    while len(i):  # one link a node and round, so a dense group costs a few vector operations and not one a link
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        keep = low != high
        i, j, low, high = i[keep], j[keep], low[keep], high[keep]
        _, one = np.unique(high, return_index=True)
        for x in one:
            a, b = root(int(low[x])), root(int(high[x]))
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((int(i[x]), int(j[x])))
        label = np.array([root(x) for x in range(n)])
    return out
