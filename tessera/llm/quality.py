"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by class log-count ratios (counted over every
labelled training row), then a linear hinge-loss model is fitted by dual
coordinate descent on a bounded sample of the labelled rows and calibrated
to a probability.  Of a sampled row with more than SAMPLE_BUCKETS indicators those of least hash are
fitted on, so the sample is bounded in bytes; ratios and scores use all.

Indicators of a text, hashed to 2**BITS buckets: words and word pairs, runs
of three bytes, and runs of four word shapes (letters, digits, symbols,
and whether the word repeats the one before it).

Edge cases: a null or empty text has no indicator and scores from the bias
alone; a null label or a label other than 0 and 1 is not learned from; with
labels of one class only (or none) every text scores that class's share (or
0.5); repeated rows of a doc_id each get a row; repeated label rows of a doc_id count once, by
the smallest label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Shared, stored, summed
from .textkit import SPACE, U, Words, breaks, column_bytes, is_long, least_hashed, mix, pieces, word_before, words_ahead

BITS = 18
#: Labelled rows that the hinge-loss model is fitted on, and the share of them kept for calibration.
SAMPLE_ROWS, CALIBRATE = 4000, 0.25
#: Indicators of a sampled row that the hinge-loss model is fitted on: the sample takes 4 bytes for each, 256 MB at most.
SAMPLE_BUCKETS = 16_384
SLICE = 1 << 12


def _shapes(w: Words) -> np.ndarray:
    """A small integer for the make-up of each word."""
    kind = np.zeros(256, np.int64)
    kind[[*range(97, 123), *range(128, 256)]] = 1
    kind[48:58] = 1 << 20
    kind[[c for c in range(33, 127) if not chr(c).isalnum()]] = 1 << 40
    sums = np.add.reduceat(np.where(w.solid, kind[w.low], 0), w.start) if len(w.start) else np.zeros(0, np.int64)
    letters, digits, symbols = sums & 0xFFFFF, (sums >> 20) & 0xFFFFF, sums >> 40
    same = np.zeros(len(sums), np.int64)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    return (letters > 0) + 2 * (digits > 0) + 4 * np.minimum(symbols, 3) + 16 * same


def indicators(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, bucket) pairs of some rows, ordered by row.  A long text is read in stretches that begin a word early and go on for three."""
    if not is_long(offsets):
        return _indicators(buf, offsets)
    cuts, feats = breaks(buf), []
    for a, z in zip(cuts, cuts[1:]):
        part = buf[word_before(buf, a):words_ahead(buf, z, 3)]
        feats.append(_indicators(part, np.array([0, len(part)]), from_middle=a > 0)[1])
    feat = np.unique(np.concatenate(feats))
    return np.zeros(len(feat), np.int64), feat


def _indicators(buf: np.ndarray, offsets: np.ndarray, from_middle: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """from_middle: the first word follows another, which isn't here, so runs of shapes begin at the second."""
    w = Words(buf, offsets)
    rows, feats = [w.row], [mix(w.hash + U(1))]
    pair = np.flatnonzero(w.row[1:] == w.row[:-1])
    rows.append(w.row[pair])
    feats.append(mix(w.hash[pair] * U(3) + w.hash[pair + 1] * U(5)))
    shape = _shapes(w).astype(np.uint64)
    if len(shape) > 3:
        run = np.flatnonzero(w.row[3:] == w.row[:-3])[int(from_middle):]
        code = shape[run] | shape[run + 1] << U(8) | shape[run + 2] << U(16) | shape[run + 3] << U(24)
        rows.append(w.row[run])
        feats.append(mix(code + U(7 << 40)))
    if len(buf) > 2:
        # one of the three bytes may be the last of its row: those runs are left out
        low = np.where(SPACE[w.low], 32, w.low).astype(np.uint32)
        row = np.repeat(np.arange(w.rows), np.diff(offsets))
        ok = row[2:] == row[:-2]
        code = (low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16))[ok]
        rows.append(row[2:][ok])
        feats.append(_spread(code))
    row = np.concatenate(rows).astype(np.uint64)
    feat = np.concatenate([f >> U(64 - BITS) if f.dtype == np.uint64 else f for f in feats]).astype(np.uint64)
    key = row << U(BITS) | feat
    key = key.astype(np.uint32) if w.rows < 1 << (32 - BITS) else key
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> key.dtype.type(BITS)).astype(np.int64), (key & key.dtype.type((1 << BITS) - 1)).astype(np.int64)


def _spread(code: np.ndarray) -> np.ndarray:
    """Buckets of 24-bit codes."""
    code = code * np.uint32(2654435761)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    return code >> np.uint32(32 - BITS)


@dataclass
class QualityModel:
    """weight of each bucket's indicator, bias, and the two numbers of the calibration."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for i, b, o in pieces(buf, offsets):
            row, feat = indicators(b, o)
            out[i:i + len(o) - 1] = np.bincount(row, self.weight[feat], minlength=len(o) - 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * (out + self.bias) + self.shift, -60, 60)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold each bucket; a row for each slice of the buckets."""
    sums, docs = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        buf, off = column_bytes(batch.column("text"))
        label = np.asarray(batch.column("label"))
        docs += np.bincount(label, minlength=2)[:2]
        for i, b, o in pieces(buf, off):
            row, feat = indicators(b, o)
            y = label[i + row]
            for c in (0, 1):
                sums[c] += np.bincount(feat[y == c], minlength=1 << BITS)
    # slices 0.. hold class 0, the next as many class 1, the last the documents of either
    parts = [*sums.reshape(-1, SLICE), docs]
    yield pa.record_batch({"slice": pa.array(range(len(parts)), pa.int32()), "part": pa.array([TaskContext.get().partitionId()] * len(parts), pa.int32()), "counts": pa.array([p.tobytes() for p in parts], pa.binary())})


class Rows:
    """The buckets of some rows in one array, in an order that doesn't depend on how the rows arrived."""

    def __init__(self, column):
        column = column.combine_chunks()
        self.flat, self.cut = np.asarray(column.flatten()), np.asarray(column.offsets).astype(np.int64) - (column.offsets[0].as_py() if len(column) else 0)
        sums = np.append(0, np.cumsum(self.flat, dtype=np.int64))[self.cut]
        self.order = np.lexsort((np.diff(self.cut), np.diff(sums)))

    def __getitem__(self, i: int) -> np.ndarray:
        i = self.order[i]
        return self.flat[self.cut[i]:self.cut[i + 1]]


def _features(most: int):
    """A task that gives the buckets of each row's indicators, at most ``most`` of a row, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = column_bytes(batch.column("text"))
            for i, b, o in pieces(buf, off):
                row, feat = indicators(b, o)
                cut = np.searchsorted(row, np.arange(len(o)))
                rows = [x + least_hashed(feat[x:y], most) for x, y in zip(cut, cut[1:])]
                yield pa.record_batch({"label": batch.column("label").slice(i, len(o) - 1), "feats": pa.array([feat[r].astype(np.int32) for r in rows], pa.list_(pa.int32()))})

    return run


def dual_coordinate_descent(rows: Rows, values: np.ndarray, y: np.ndarray, train: np.ndarray, cost: float, epochs: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss, dual form: one variable per row, each solved exactly in turn (Hsieh et al. 2008).

    values: the value of each bucket's indicator; cost: of either class, balanced by the classes' counts.
    """
    w, bias = np.zeros(len(values)), 0.0
    squares = values * values
    diag = {i: squares[rows[i]].sum() + 1 for i in train}
    label = y[train]
    top = {i: cost * len(train) / (2 * max(1, (label == y[i]).sum())) for i in train}
    alpha, rng = np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(train):
            r = rows[i]
            v = values[r]
            gradient = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / diag[i], 0.0), top[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                bias += step
                moved = max(moved, abs(new - alpha[i]) * diag[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of the label on the margin, by Newton's steps with a small ridge."""
    x, t = np.stack([margin, np.ones_like(margin)], 1), (y > 0).astype(float)
    t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * (b - [1, 0]))
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def fit_quality(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, cost: float = 0.1, epochs: int = 20, blend: float = 0.25, buckets: int = SAMPLE_BUCKETS) -> QualityModel:
    """labelled: columns doc_id, text, label (0 or 1), training rows only.

    Ratios come from all of these rows; the hinge-loss model from one text of each of the ``sample_rows``
    ids of smallest hash, with at most ``buckets`` of its indicators.
    """
    rows = labelled.select("text", F.col("label").cast("int")).mapInArrow(_count, "slice int, part int, counts binary")
    parts = {s: np.frombuffer(c, np.int64) for s, _, c in summed(stored(rows)).collect()}
    last = 2 * (1 << BITS) // SLICE
    counts = np.concatenate([parts.get(s, np.zeros(SLICE)) for s in range(last)]).reshape(2, -1).astype(float)
    docs = parts.get(last, np.zeros(2)).astype(float)
    if not docs.all():
        share = 0.5 if not docs.any() else float(docs[1] > 0)
        return QualityModel(np.zeros(1 << BITS), 0.0, 1.0, 30.0 * (2 * share - 1))
    p, q = counts[1] + 1, counts[0] + 1
    ratio = np.log(p / (docs[1] + 2)) - np.log(q / (docs[0] + 2))
    chosen = labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    picked = labelled.join(F.broadcast(chosen), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("label").cast("int").alias("label"))
    rows = picked.select("text", "label").mapInArrow(_features(buckets), "label int, feats array<int>").toArrow()
    feats = Rows(rows["feats"])
    y = np.where(rows["label"].to_numpy() == 1, 1.0, -1.0)[feats.order]
    values = ratio / np.sqrt(max(1.0, np.median(np.diff(feats.cut))))
    held = np.random.default_rng(1).random(len(y)) < CALIBRATE
    w, bias = dual_coordinate_descent(feats, values, y, np.flatnonzero(~held), cost, epochs)
    w = (1 - blend) * np.abs(w[w != 0]).mean() + blend * w if (w != 0).any() else w
    weight = w * values
    margin = np.array([weight[feats[i]].sum() + bias for i in range(len(y))])
    slope, shift = _calibrate(margin[held], y[held]) if len(set(y[held])) == 2 else (1.0, 0.0)
    return QualityModel(weight, bias, slope, shift)


def quality_scores(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """Every row of ``docs`` with a column ``name``, the probability of label 1; a column of docs by that name is replaced."""
    shared = Shared(docs.sparkSession, model)  # a fixed 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b, o in pieces(*column_bytes(batch.column("text"))):
                part = batch.slice(i, len(o) - 1)
                yield pa.record_batch([*part.columns, pa.array(shared.value.scores(b, o))], names=[*batch.schema.names, name])

    docs = docs.drop(name)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def labelled_rows(docs: DataFrame, labels: DataFrame, keep: Column) -> DataFrame:
    """doc_id, text, label of the documents whose label is 0 or 1 and whose id meets ``keep``."""
    quality = labels.select("doc_id", F.col("quality").alias("label")).filter(F.col("label").isin(0, 1) & keep).groupBy("doc_id").agg(F.min("label").alias("label"))
    # merged at every size: the labels grow with the documents, so they are never broadcast
    return docs.filter(keep).select("doc_id", "text").join(quality.hint("merge"), "doc_id")
