"""Approximate nearest neighbours by largest inner product.

A hierarchical k-means tree is fitted on a bounded sample; every row is
indexed, in the leaf that a descent to the nearest centres ends in.  A query
walks the tree best bin first: a priority queue holds nodes by the inner
product with their centres, and leaves are visited as they come up.  How many leaves
is calibrated: visits widen until held-out sample queries reach the recall
asked for against brute force over the sample (whose neighbours lie farther
apart than those among all rows, so the figure is on the safe side), and a
query goes on past that until its leaves hold ``spare`` times k rows.

A leaf of more than SPLIT_ROWS rows gets a tree of its own, fitted and calibrated in a task on about SAMPLE_ROWS of its rows,
where neighbours are closer; a query that comes to the leaf walks that tree too.  So the
share of the table that a query reads falls as the table grows, and what is broadcast is bounded by the two samples.

Leaves lie in buckets of about BUCKET_ROWS rows, neighbours together; a leaf
of more rows is dealt over several buckets by hash.  Each bucket is one group of a cogroup
with the queries that visit it, and yields k rows a query at most.

Edge cases: vectors that are null, zero, or hold a null or non-finite
component take no part, nor do those of another length than most; ties go to the smaller vec_id; rows with the
query's own vec_id are not candidates; repeated rows of another vec_id each
count; an empty table gives no row.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Shared, stored

#: Rows that the tree is fitted and calibrated on.
SAMPLE_ROWS, SAMPLE_QUERIES = 12_000, 200
BRANCH, LEAF_SAMPLE, BUCKET_ROWS, QUERY_BLOCK = 8, 40, 4096, 256
#: Rows from which on a leaf is divided by a tree of its own.
SPLIT_ROWS = 16 * BUCKET_ROWS


@dataclass
class Tree:
    """Nodes in depth-first order: centre, children (none: a leaf), leaf number (-1: inner); and the trees of divided leaves."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    visits: int = 1
    below: dict[int, Tree] = field(default_factory=dict)

    @property
    def first(self) -> np.ndarray:
        """The number of each leaf's first part, and how many there are in all."""
        parts = np.ones(int((self.leaf >= 0).sum()), np.int64)
        for number, tree in self.below.items():
            parts[number] = tree.leaves
        return np.append(0, np.cumsum(parts))

    @property
    def leaves(self) -> int:
        return int(self.first[-1])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf number of each row."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        first = self.first
        while todo:
            node, at = todo.pop()
            kids = self.children[node]
            if not kids:
                number = int(self.leaf[node])
                out[at] = first[number] + (self.below[number].assign(x[at]) if number in self.below else 0)
                continue
            c = self.centres[kids]
            near = ((c * c).sum(1) - 2 * x[at] @ c.T).argmin(1)
            todo += [(kid, at[near == i]) for i, kid in enumerate(kids) if (near == i).any()]
        return out

    def walk(self, q: np.ndarray) -> Iterator[list[int]]:
        """Leaf numbers, best bin first; of a divided leaf those of as many parts as its tree is to visit."""
        along, first = self.centres @ q, self.first
        queue = [(-along[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            number = int(self.leaf[node])
            if number in self.below:
                tree = self.below[number]
                yield [int(first[number]) + part for parts in islice(tree.walk(q), tree.visits) for part in parts]
            elif number >= 0:
                yield [int(first[number])]
            for kid in self.children[node]:
                heapq.heappush(queue, (-along[kid], kid))


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """The cluster of each row."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        size = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], x[rng.choice(len(x), k)])
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


def fit_tree(x: np.ndarray, branch: int = BRANCH, leaf_sample: int = LEAF_SAMPLE, seed: int = 0) -> Tree:
    rng = np.random.default_rng(seed)
    centres, children, leaf = [], [], []

    def grow(at: np.ndarray) -> int:
        me = len(centres)
        centres.append(x[at].mean(0))
        children.append([])
        leaf.append(-1)
        parts = []
        if len(at) > leaf_sample:
            near = k_means(x[at], min(branch, len(at)), rng)
            parts = [at[near == c] for c in np.unique(near)]
        if len(parts) > 1:
            children[me] = [grow(p) for p in parts]
        else:
            leaf[me] = sum(n >= 0 for n in leaf)
        return me

    grow(np.arange(len(x)))
    return Tree(np.stack(centres), children, np.array(leaf, np.int32))


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float, queries: int = SAMPLE_QUERIES) -> int:
    """The number of visits at which sample rows, as queries over the others, reach ``recall``."""
    at = tree.assign(x)
    picked = np.random.default_rng(3).choice(len(x), min(queries, len(x)), replace=False)
    ranks = []
    for i in picked:
        score = x @ x[i]
        score[i] = -np.inf
        top = np.argsort(-score, kind="stable")[:min(k, len(x) - 1)]
        order = np.zeros(tree.leaves, int)
        for turn, numbers in enumerate(tree.walk(x[i]), 1):
            order[numbers] = turn
        ranks.append(order[at[top]])
    if not ranks or not len(ranks[0]):
        return tree.leaves
    ranks = np.concatenate(ranks)
    visits = 1
    while visits < tree.leaves and (ranks <= visits).mean() < recall:
        visits += 1
    return visits


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    real = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vector.isNotNull() & real & F.exists(vector, lambda v: v != 0)


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten() if len(column) else pa.array([], pa.float64())
    return np.asarray(flat).astype(np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.97, spare: int = 4, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query row, nearest first.

    vectors: vec_id, embedding.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("_q")).filter(usable(F.col("embedding")))
    common = good.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = int(common[0]), int(common[1])
    good = good.filter(F.size("embedding") == dim)
    sample = good.select("embedding", F.xxhash64("vec_id", "embedding").alias("h")).distinct().orderBy("h").limit(sample_rows).toArrow()
    x = np.unique(_matrix(sample["embedding"], dim), axis=0)
    tree = fit_tree(x)
    tree.visits = calibrate(tree, x, k, recall)
    held = Shared(spark, tree)  # fitted on the sample: bounded

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"vec_id": b.column("vec_id"), "embedding": b.column("embedding"), "_q": b.column("_q"), "leaf": pa.array(held.value.assign(_matrix(b.column("embedding"), dim)))})

    def sizes(indexed: DataFrame) -> np.ndarray:
        out = np.zeros(tree.leaves, np.int64)
        for leaf, n in indexed.groupBy("leaf").count().collect():  # a row for each leaf
            out[leaf] = n
        return out

    schema = "vec_id long, embedding array<double>, _q boolean, leaf int"
    indexed = stored(good.mapInArrow(index, schema))
    size = sizes(indexed)
    if large := [(leaf, min(1.0, sample_rows / int(size[leaf]))) for leaf in range(tree.leaves) if size[leaf] > SPLIT_ROWS]:

        def divide(key, t):
            own = np.unique(_matrix(t["embedding"], dim), axis=0)
            part = fit_tree(own)
            part.visits = calibrate(part, own, k, recall)
            made = pickle.dumps((part.centres, part.children, part.leaf, part.visits))
            return pa.table({"leaf": pa.array([key[0].as_py()], pa.int32()), "tree": pa.array([made], pa.binary())})

        rates = F.broadcast(spark.createDataFrame(large, "leaf int, rate double"))  # a row for each large leaf
        place = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        picked = indexed.join(rates, "leaf").filter(place < F.col("rate")).select("leaf", "embedding").distinct()
        for leaf, made in picked.groupBy("leaf").applyInArrow(divide, "leaf int, tree binary").collect():  # of bounded size, for each leaf of the bounded tree
            tree.below[leaf] = Tree(*pickle.loads(made))
        held = Shared(spark, tree)
        indexed = stored(indexed.drop("leaf").mapInArrow(index, schema))
        size = sizes(indexed)
    first, parts, at, room = np.zeros(tree.leaves, np.int64), np.ones(tree.leaves, np.int64), 0, BUCKET_ROWS
    for leaf in range(tree.leaves):  # small leaves share a bucket, large ones have several
        if size[leaf] > BUCKET_ROWS:
            first[leaf], parts[leaf] = at + 1, -(-size[leaf] // BUCKET_ROWS)
            at, room = at + parts[leaf], 0
        else:
            if size[leaf] > room:
                at, room = at + 1, BUCKET_ROWS
            first[leaf], room = at, room - size[leaf]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        for b in batches:
            where: dict[tuple[int, int], list[int]] = {}
            for i, q in enumerate(_matrix(b.column("embedding"), dim)):
                rows = 0
                for turn, numbers in enumerate(t.walk(q), 1):
                    for leaf in numbers:
                        rows += size[leaf]
                        for bucket in range(first[leaf], first[leaf] + parts[leaf]):
                            where.setdefault((i, bucket), []).append(leaf)
                    if turn >= t.visits and rows > spare * k:
                        break
            at = np.array([i for i, _ in where], np.int64)
            yield pa.record_batch({"query_id": b.column("vec_id").take(pa.array(at)), "q": b.column("embedding").take(pa.array(at)), "bucket": pa.array([int(x) for _, x in where], pa.int64()), "visits": pa.array(list(where.values()), pa.list_(pa.int32()))})

    queries = indexed.filter("_q").select("vec_id", "embedding").mapInArrow(ask, "query_id long, q array<double>, bucket long, visits array<int>")
    lookup = spark.createDataFrame([(leaf, int(first[leaf]), int(parts[leaf])) for leaf in range(tree.leaves)], "leaf int, f long, n long")
    rows = indexed.join(F.broadcast(lookup), "leaf").select("vec_id", "embedding", "leaf", (F.col("f") + F.pmod(F.xxhash64("vec_id", "embedding"), "n")).alias("bucket"))

    def search(left, right):
        q, r, ids = _matrix(left["q"], dim), _matrix(right["embedding"], dim), right["vec_id"].to_numpy()
        leaf, own = right["leaf"].to_numpy(), left["query_id"].to_numpy()
        visits = left["visits"].combine_chunks() if len(left) else None
        out: list[tuple] = []
        for a in range(0, len(q) if len(r) else 0, QUERY_BLOCK):
            block = q[a:a + QUERY_BLOCK]
            score = block @ r.T
            allowed = np.zeros((len(block), int(leaf.max()) + 1), bool)
            for i in range(len(block)):
                v = np.asarray(visits[a + i].values)
                allowed[i, v[v < allowed.shape[1]]] = True
            score[~allowed[:, leaf] | (ids[None, :] == own[a:a + QUERY_BLOCK, None])] = -np.inf
            kth = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(block), -np.inf)
            for i in range(len(block)):
                # a matrix product may round equal rows differently: take all near the k-th, and sum each anew
                slack = 1e-9 * (1 + abs(kth[i])) if np.isfinite(kth[i]) else 0
                c = np.flatnonzero((score[i] >= kth[i] - slack) & np.isfinite(score[i]))
                exact = (r[c] * block[i]).sum(axis=1)
                top = np.lexsort((ids[c], -exact))[:k]
                out.append((np.full(len(top), own[a + i]), ids[c][top], exact[top]))
        parts_ = [np.concatenate(p) for p in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(parts_[0], pa.int64()), "vec_id": pa.array(parts_[1], pa.int64()), "score": pa.array(parts_[2], pa.float64())})

    found = queries.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
