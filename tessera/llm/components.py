"""Connected components of a table of links, by alternating stars over links that are contracted first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored

#: Links that a task gathers before it contracts them.
PENDING = 1 << 20
MOST_ROUNDS = 100


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes in order, the least node that each reaches) of links a[i] - b[i]."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    up = np.arange(len(nodes))
    while len(x):
        p, q = up[x], up[y]
        open_ = p != q
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while (up[up] != up).any():
            up = up[up]
    return nodes, nodes[up]


class Contraction:
    """Links taken in one after the other; what they connect is kept as one link from every node to the least one that it reaches."""

    def __init__(self):
        self.u = self.v = np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.waiting.append((a, b))
        self.pending += len(a)
        if self.pending >= PENDING + len(self.u):
            self.links()

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        nodes, root = roots(*(np.concatenate(x) for x in zip((self.u, self.v), *self.waiting)))
        own = nodes != root
        self.u, self.v, self.waiting, self.pending = nodes[own], root[own], [], 0
        return self.u, self.v


def contracted(links: DataFrame) -> DataFrame:
    """u, v: for the links (u, v) of each task, one from every node to the least node that it reaches by them."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Contraction()
        for batch in batches:
            held.add(batch.column("u").to_numpy(), batch.column("v").to_numpy())
        u, v = held.links()
        yield pa.record_batch({"u": pa.array(u), "v": pa.array(v)})

    return links.mapInArrow(contract, "u long, v long")


def are_stars(links: DataFrame) -> bool:
    """Whether every node is linked once (a leaf), or only linked to (a centre)."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    per = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return per.filter("leaf + centre > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long).  Returns node, root: the smallest node reachable, for every node of a link between two nodes.

    Links meet by their larger node and are contracted there, which leaves about one for every node.  Each round then points the larger
    neighbours of every node, then the smaller ones, at the least neighbour; it ends when only stars are left.
    Self-links and nulls are left out; repeated links count once.
    """
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = stored(contracted(e.repartition("u")))
    for _ in range(MOST_ROUNDS):
        if are_stars(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components are not found after {MOST_ROUNDS} rounds")
