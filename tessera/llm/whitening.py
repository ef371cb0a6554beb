"""Embedding whitening by Chebyshev-filtered subspace iteration.

Each entry c becomes the integer x = floor(1024 c) + 100000.  The leading
eigenvectors of the covariance V of all rows are found without forming V: a
block Q of BLOCK orthonormal columns is sent to the tasks, and one pass over the rows gives
V Q = sum of (x - mean) (x - mean)' Q / n, centred before anything is multiplied.  A
Chebyshev polynomial of V, by its three-term recurrence with one pass a degree, damps the spectrum below the block's
smallest Ritz value; then QR and a Rayleigh-Ritz step.  The rounds end when the residuals |Vq - eq| of the wanted
components certify them (CERTIFIED times the largest eigenvalue), or no longer fall because double precision ends there; the
largest is kept in the column ``residual``, as a share of the largest eigenvalue.

Rows lie in a stored table of packed blocks, so a pass reads numbers only; a
task sends one matrix of dimensions x BLOCK, and many are added up in rounds.

Edge cases: vectors that are null or hold null or non-finite entries are
dropped, and so are those of another length than most (among equally common lengths the
shortest stays); null or repeated vec_ids and repeated rows count as rows by themselves; entries whose x lies beyond ±2^44
count as that; components without variance (one row, equal rows, fewer rows than dimensions) are not there, as nothing can be
scaled to variance one; a deviation beyond 64 bits is null; an empty table, or vectors without entries, give no row.  Of
each component the entry of largest size is positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: Columns of the block, degree of a filter, most filters, and the residual, as a share of the largest eigenvalue, that ends the rounds.
BLOCK, DEGREE, ROUNDS, CERTIFIED = 32, 10, 60, 1e-14
#: Bytes of a packed block of rows, matrices that the driver adds up, and the largest |x|.
BLOCK_BYTES, SUM_PARTS, LARGEST = 1 << 20, 64, 1 << 44


def finite(vector: Column) -> Column:
    """Not null and without null or non-finite entries."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))


def packed(vectors: DataFrame, dim: int) -> DataFrame:
    """Blocks of rows: part (of the task), vec_id, x (as bytes), number of rows, largest |x|, sums by dimension."""
    rows = max(1, BLOCK_BYTES // (8 * dim))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.asarray(b.column("embedding").flatten()).astype(np.float64).reshape(-1, dim)
            for a in range(0, len(flat), rows):
                x = np.clip(np.floor(1024 * flat[a:a + rows]), -float(LARGEST), float(LARGEST)).astype(np.int64) + 100_000
                ids = b.column("vec_id").slice(a, rows)
                yield pa.record_batch({"vec_id": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "x": pa.array([x.tobytes()], pa.binary()), "n": pa.array([len(x)], pa.int64()), "peak": pa.array([int(np.abs(x).max())], pa.int64()), "sums": pa.array([x.sum(0)], pa.list_(pa.int64()))})

    blocks = vectors.mapInArrow(pack, "vec_id array<long>, x binary, n long, peak long, sums array<long>")
    return blocks.select("*", F.spark_partition_id().alias("part"))


class Centred:
    """x - S/n of packed rows, from exact integers wherever n x - S fits 62 bits."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.dim, self.exact = n, len(sums), 2 * n * largest < 1 << 62
        self.sums = np.array(sums, np.int64 if self.exact else object)
        self.mean = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n / n for s in sums])

    def scaled(self, data: bytes) -> np.ndarray:
        """n x - S, as integers."""
        x = np.frombuffer(data, np.int64).reshape(-1, self.dim)
        return self.n * (x if self.exact else x.astype(object)) - self.sums

    def rows(self, data: bytes) -> np.ndarray:
        if self.exact:
            return self.scaled(data).astype(np.float64) / self.n
        return (np.frombuffer(data, np.int64).reshape(-1, self.dim) - self.mean).astype(np.float64) - self.rest

    def deviations(self, data: bytes) -> list[int | None]:
        c = self.scaled(data)
        if self.exact and (not c.size or int(np.abs(c).max()) ** 2 * self.dim < 1 << 63):
            return (c * c).sum(1).tolist()
        total = (c.astype(object) ** 2).sum(1)
        return [int(t) if t < 1 << 63 else None for t in total]


def added(blocks: DataFrame, parts: int, work, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all blocks of ``work(x)``, a matrix: one matrix a task, added up in rounds of SUM_PARTS."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, 0
        for b in batches:
            for data, part in zip(b.column("x"), b.column("part")):
                one = work(data.as_py())
                total, part = one if total is None else total + one, part.as_py()
        if total is not None:
            yield pa.record_batch({"part": pa.array([part], pa.int64()), "m": pa.array([total.tobytes()], pa.binary())})

    def add(key, t):
        total = np.sum([np.frombuffer(m.as_py()) for m in t["m"]], axis=0)
        return pa.table({"part": key[:1], "m": pa.array([total.tobytes()], pa.binary())})

    sums = blocks.select("x", F.col("part").cast("long").alias("part")).mapInArrow(partial, "part long, m binary")
    while parts > SUM_PARTS:
        parts = -(-parts // SUM_PARTS)
        sums = sums.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("part").applyInArrow(add, "part long, m binary")
    return np.sum([np.frombuffer(m).reshape(shape) for m in sorted(r["m"] for r in sums.toArrow().to_pylist())], axis=0)


def subspace(times, dim: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, eigenvectors, largest residual as a share of the largest eigenvalue) of the wanted leading components.

    times(Q): V Q by a pass over the rows.
    """
    k = min(dim, max(BLOCK, 2 * wanted))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, k)))[0]
    before = np.inf
    for turn in range(ROUNDS):
        z = times(q)
        h = q.T @ z
        e, u = np.linalg.eigh((h + h.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        q, z = q @ u, z @ u
        if e[0] <= 0:
            return e[:0], q[:, :0], 0.0
        residual = float(np.linalg.norm(z - q * e, axis=0)[:wanted].max() / e[0])
        if residual <= CERTIFIED or k == dim or residual < 1e-11 and residual > before / 2:
            break
        before = residual
        # the spectrum of V from 0 to the smallest Ritz value goes to [-1, 1], where Chebyshev polynomials stay small; scaled to stay in range
        half = centre = max(e[-1], 1e-12 * e[0]) / 2
        s = half / (e[0] - centre)
        tau = 2 / s
        a, b = q, (z - centre * q) * (s / half)
        for _ in range(DEGREE - 1):
            nxt = 1 / (tau - s)
            a, b = b, (times(b) - centre * b) * (2 * nxt / half) - s * nxt * a
            s = nxt
        q = np.linalg.qr(b)[0]
    there = e[:wanted] > 1e-13 * dim * e[0]
    e, q = e[:wanted][there], q[:, :wanted][:, there]
    return e, q * np.sign(q[np.abs(q).argmax(0), np.arange(q.shape[1])]), residual


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, residual: a row for each row of ``vectors`` (vec_id, embedding) and leading component."""
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(finite(F.col("embedding")))
    common = good.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None or not common[0]:
        return spark.createDataFrame([], schema)
    dim = int(common[0])
    blocks = stored(packed(good.filter(F.size("embedding") == dim), dim))
    n, parts, peak = (int(v) for v in blocks.agg(F.sum("n"), F.max("part") + 1, F.max("peak")).first())
    by_dim = blocks.select(F.posexplode("sums").alias("d", "s")).groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row a dimension
    sums = [int(Decimal(r["s"])) for r in sorted(by_dim)]
    centred = Centred(n, sums, peak)

    def times(q: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(q)  # dimensions x BLOCK

        def work(data: bytes) -> np.ndarray:
            c = centred.rows(data)
            return c.T @ (c @ sent.value)

        return added(blocks, parts, work, q.shape) / n

    trace = float(added(blocks, parts, lambda data: np.square(centred.rows(data)).sum().reshape(1, 1), (1, 1))[0, 0]) / n
    if trace <= 0:
        return spark.createDataFrame([], schema)
    e, q, residual = subspace(times, dim, min(components, dim))
    scale, found = q / np.sqrt(e), len(e)

    def moments(data: bytes) -> np.ndarray:
        w = centred.rows(data) @ scale
        return np.vstack([w.sum(0), w.T @ w])

    m = added(blocks, parts, moments, (found + 1, found)) / n
    error = float(np.abs(m[1:] - np.outer(m[0], m[0]) - np.eye(found)).max())
    explained = e / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, data in zip(b.column("vec_id"), b.column("x")):
                x = data.as_py()
                w, each = centred.rows(x) @ scale, np.repeat(np.arange(len(ids.values)), found)
                rows = len(each)
                yield pa.record_batch({
                    "vec_id": ids.values.take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(w))), "n": pa.array(np.full(rows, n)), "deviation": pa.array(centred.deviations(x), pa.int64()).take(pa.array(each)),
                    "whitened": pa.array(w.ravel()), "explained": pa.array(np.tile(explained, len(w))), "identity_error": pa.array(np.full(rows, error)), "residual": pa.array(np.full(rows, residual)),
                })

    return blocks.select("vec_id", "x").mapInArrow(project, schema)
