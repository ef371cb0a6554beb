"""Language identification.

A text is the average of the embeddings of its hashed subwords (runs of two,
three and four bytes, white space taken as one blank, A-Z lower-cased); a linear softmax
reads that average.  Embeddings and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample, the probabilities
are scaled by a temperature, and the rejection threshold is the quantile of
the winning probability that accepts ``accept`` of the calibration rows that
were predicted rightly.

The sample has about SAMPLE_ROWS rows in all and SAMPLE_PER_LANGUAGE of a
language: a language's rows are picked by hash, at the rate that gives so many
different ones, so no task gathers a language.  Of a row with more than SAMPLE_BUCKETS subwords those of least hash
are learned from, so the sample is bounded in bytes; predictions use all.  Every language is learned; what is
broadcast is the embeddings (2**BITS x DIM numbers) and DIM + 1 numbers a language.

Edge cases: a null text and a text without a letter are ``und`` with score
0; with no training row everything is ``und``; null languages are not
learned; a text of one byte has no subword and gets the classes' priors;
repeated rows each get a row, and are one row of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import Shared, stored
from .textkit import LOWER, PIECE, SPACE, column_bytes, is_long, least_hashed, pieces

BITS, DIM, ORDERS = 16, 16, (2, 3, 4)
#: Rows that the model is trained on: about so many of each language, and about so many in all.
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 800, 12_000
#: Buckets of a sampled row that are learned from: the sample takes 8 bytes for each, 400 MB at most.
SAMPLE_BUCKETS = 4096
#: Languages whose rates (two values each) are broadcast; those of more are joined by shuffle.
BROADCAST_LANGUAGES = 50_000


def subwords(buf: np.ndarray, offsets: np.ndarray):
    """(row, bucket) arrays, a pair for each length of subword; for each stretch of a long text."""
    if is_long(offsets):
        for c in range(0, len(buf), PIECE):
            start = max(0, c - max(ORDERS) + 1)
            part = buf[start:c + PIECE]
            for n, (row, bucket) in zip(ORDERS, subwords(part, np.array([0, len(part)]))):
                done = max(0, c - start - n + 1)  # those that end in the stretch before
                yield row[done:], bucket[done:]
        return
    low = np.where(SPACE[buf], 32, LOWER[buf]).astype(np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    code = low
    for n in range(2, max(ORDERS) + 1):
        if len(low) < n:
            return
        code = code[:-1] << np.uint32(8) | low[n - 1:]
        if n in ORDERS:
            ok = row[n - 1:] == row[:len(row) - n + 1]
            h = (code * np.uint32(2654435761)) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            yield row[n - 1:][ok], (h >> np.uint32(32 - BITS))[ok]


@dataclass
class LanguageModel:
    """languages; embedding of each bucket; softmax weights and bias; temperature; rejection threshold."""

    languages: list[str]
    embed: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, k = len(offsets) - 1, len(self.languages)
        # an average of logits is the logit of the average: the narrower of the two is summed up
        parts, last = (np.ascontiguousarray((self.embed @ self.out).T), np.eye(k)) if k <= DIM else (np.ascontiguousarray(self.embed.T), self.out)
        z = np.zeros((n, k))
        for i, b, o in pieces(buf, offsets):
            rows = len(o) - 1
            sums, count = np.zeros((rows, len(parts))), np.zeros(rows)
            for row, bucket in subwords(b, o):
                count += np.bincount(row, minlength=rows)
                for c, part in enumerate(parts):
                    sums[:, c] += np.bincount(row, part[bucket], minlength=rows)
            z[i:i + rows] = sums / np.maximum(count, 1)[:, None] @ last
        z = (z + self.bias) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True)) if n else z
        return p / p.sum(axis=1, keepdims=True)


def _counts(most: int):
    """A task that gives the buckets of each row and how often it has them, at most ``most`` of a row, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = column_bytes(batch.column("text"))
            for i, b, o in pieces(buf, off):
                parts = [np.unique(r.astype(np.int64) << BITS | f, return_counts=True) for r, f in subwords(b, o)]
                key, back = np.unique(np.concatenate([k for k, _ in parts] or [np.zeros(0, np.int64)]), return_inverse=True)
                times = np.bincount(back, np.concatenate([t for _, t in parts] or [np.zeros(0)]), len(key))
                cut = np.searchsorted(key >> BITS, np.arange(len(o)))
                rows = [x + least_hashed(key[x:y] & ((1 << BITS) - 1), most) for x, y in zip(cut, cut[1:])]
                yield pa.record_batch({
                    "lang": batch.column("lang").slice(i, len(o) - 1),
                    "feats": pa.array([(key[r] & ((1 << BITS) - 1)).astype(np.int32) for r in rows], pa.list_(pa.int32())),
                    "times": pa.array([times[r].astype(np.float32) for r in rows], pa.list_(pa.float32())),
                })

    return run


def language_sample(training: DataFrame, per_language: int, total: int) -> DataFrame:
    """lang, text: about ``per_language`` different rows of each language, fewer where that makes more than ``total``."""
    known = training.filter(F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    held = stored(known.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")))
    languages = held.count()
    wanted = max(1.0, min(float(per_language), total / max(1, languages)))
    # of n different rows, the wanted share: hashes below it; a few rows are all taken
    rate = held.select("lang", F.when(F.col("n") <= 1.1 * wanted, 1.0).otherwise(wanted / F.col("n")).alias("rate"))
    rate = F.broadcast(rate) if languages <= BROADCAST_LANGUAGES else rate
    place = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    picked = known.join(rate, "lang").filter(place < F.col("rate"))
    return picked.groupBy("lang", "key").agg(F.first("text").alias("text")).select("lang", "text")


def fit_language(training: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, total: int = SAMPLE_ROWS, epochs: int = 6, rate: float = 2.0, accept: float = 0.995, buckets: int = SAMPLE_BUCKETS) -> LanguageModel:
    """training: doc_id, text, lang.  per_language, total, buckets: bounds of the sample that is learned from."""
    rows = language_sample(training, per_language, total).select("text", "lang").mapInArrow(_counts(buckets), "lang string, feats array<int>, times array<float>").toArrow()
    lang = np.array(rows["lang"].to_pylist(), object)
    languages = sorted(set(lang))
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, DIM)), np.zeros((DIM, 0)), np.zeros(0), 1.0, 0.0)
    feats, times = [np.asarray(x) for x in rows["feats"].to_numpy()], [np.asarray(x) for x in rows["times"].to_numpy()]
    order = sorted(range(len(lang)), key=lambda i: (lang[i], len(feats[i]), float(times[i].sum()), int(feats[i].sum())))
    x = [(feats[i], times[i] / max(1.0, times[i].sum())) for i in order]
    y = np.array([languages.index(lang[i]) for i in order])
    rng = np.random.default_rng(0)
    held = rng.random(len(y)) < 0.2
    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
    embed, out, bias = rng.normal(0, 1 / DIM, (1 << BITS, DIM)), np.zeros((DIM, len(languages))), np.zeros(len(languages))
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            f, t = x[i]
            step = rate * (1 - done / steps)
            done += 1
            mean = t @ embed[f] if len(f) else np.zeros(DIM)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= step * np.outer(mean, p)
            bias -= 0.01 * step * p
            if len(f):
                embed[f] -= step * len(f) ** 0.5 * np.outer(t, back)
    check = np.flatnonzero(held) if held.any() else train
    z = np.array([(x[i][1] @ embed[x[i][0]]) @ out + bias if len(x[i][0]) else bias for i in check])

    def loss(temperature: float) -> float:
        s = z / temperature
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(check)), y[check]] - np.log(np.exp(s).sum(axis=1))).mean())

    temperature = min(np.geomspace(0.05, 5, 60), key=loss)
    s = z / temperature
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
    reject = float(np.quantile(right, 1 - accept)) if len(right) else 0.0
    return LanguageModel(languages, embed, out, bias, float(temperature), reject)


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Every row of docs with lang_pred, score (probability of that language, 0 for und) and rejected (below the calibrated threshold, or und)."""
    shared = Shared(docs.sparkSession, model)  # an 8 MB table, and 17 numbers a language
    docs = docs.drop("lang_pred", "score", "rejected")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            text = batch.column("text")
            letter = pc.match_substring_regex(text, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
            if m.languages:
                p = m.probabilities(*column_bytes(text))
                best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
                score = np.where(letter, p.max(axis=1) if len(p) else 0.0, 0.0)
                name = np.where(letter, np.array(m.languages, object)[best], "und")
            else:
                score, name = np.zeros(len(text)), np.full(len(text), "und", object)
            yield pa.record_batch([*batch.columns, pa.array(name, pa.string()), pa.array(score), pa.array((name == "und") | (score < m.reject_below))], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, schema)
