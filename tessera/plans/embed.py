"""Embedding job with a swappable encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.text import prefixed
from ..functions.vectors import vector_problem


def hashing_encoder(dimension: int = 384) -> Callable[[list[str]], np.ndarray]:
    """Signed hashed words (runs of bytes that aren't ASCII white space), unit length: deterministic and offline.  A word's place is its MD5's first four hexadecimal digits modulo ``dimension``, its sign that of the fifth being odd."""

    @lru_cache(1 << 17)
    def place(word: bytes) -> int:
        h = hashlib.md5(word).hexdigest()
        return int(h[:4], 16) % dimension * 2 + int(h[4], 16) % 2

    def encode(texts: list[str]) -> np.ndarray:
        words = [text.lower().encode().split() for text in texts]
        size = [len(w) for w in words]
        code = np.fromiter(map(place, chain.from_iterable(words)), np.int64, sum(size))
        at = np.repeat(np.arange(len(texts)) * dimension, size) + code // 2
        out = np.bincount(at, code % 2 * 2 - 1, minlength=len(texts) * dimension).reshape(len(texts), dimension)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, length, out=out, where=length > 0).astype(np.float32)

    return encode


def embedded(texts: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_encoder, profile: str = "hashing-384", prefix: str = "") -> DataFrame:
    """content_hash, vector, embedding_profile_id of the distinct texts of ``texts`` (content_hash, content); the encoder is made once a task."""

    once = texts.groupBy("content_hash").agg(F.first("content").alias("content")).select("content_hash", prefixed(prefix, F.col("content")).alias("content"))
    return embedded_rows(once, "content_hash", make_encoder, profile)


#: Texts that are encoded at once.
TEXTS = 1024


def embedded_rows(rows: DataFrame, key: str, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_encoder, profile: str = "hashing-384") -> DataFrame:
    """``key`` (a string), vector, embedding_profile_id of every row of ``rows`` (key, content) where it lies: no text crosses the network."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                b = batch.slice(at, TEXTS)
                v = encode([x or "" for x in b.column("content").to_pylist()])
                ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
                yield pa.record_batch({key: b.column(key), "vector": pa.ListArray.from_arrays(ends, pa.array(v.ravel(), pa.float32()))})

    return rows.select(key, "content").mapInArrow(run, f"{key} string, vector array<float>").withColumn("embedding_profile_id", F.lit(profile))


def accepted(vectors: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(usable vectors, quarantined ones with their problem)."""
    checked = vectors.withColumn("problem", vector_problem(F.col("vector"), dimension))
    return checked.filter(F.col("problem").isNull()).drop("problem"), checked.filter(F.col("problem").isNotNull())


def compatible(vectors: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors of their source's embedding profile, others)."""
    want = sources.select("source_id", F.col("embedding_profile_id").alias("_want"))
    both = vectors.join(want, "source_id")
    same = F.col("embedding_profile_id") == F.col("_want")
    return both.filter(same).drop("_want"), both.filter(~same).drop("_want")
