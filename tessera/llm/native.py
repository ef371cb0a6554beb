"""Word-shingle expressions in DataFrame functions only, shared by the native operators."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from .common import row_key

#: Most bits of the table that screens shingles: 256 KB, whatever the data.
TABLE_BITS = 1 << 21


def words(text: Column) -> Column:
    """Lower-cased words of a text; null and empty texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(word_array: Column, k: int = 5) -> Column:
    """64-bit hashes of the runs of k words, by position."""
    return F.when(F.size(word_array) >= k, F.transform(F.sequence(F.lit(0), F.size(word_array) - k), lambda i: F.xxhash64(*(F.get(word_array, i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def bit_table(hashes: DataFrame, column: str, most: int | None = None) -> tuple[Column, int]:
    """(literal array of 64-bit groups, number of bits) with the bit of every hash in ``column`` set.

    The number of bits grows with the hashes up to TABLE_BITS, so what the driver gathers has a fixed bound;
    beyond that the table screens less and stays complete.  most: how many hashes there are, where that is known.
    """
    bits = 1 << 12
    n = hashes.select(column).distinct().count() if most is None else most
    while bits < 4096 * n and bits < TABLE_BITS:
        bits *= 2
    at = F.pmod(F.col(column), F.lit(bits))
    groups = hashes.select(F.expr(f"cast(pmod({column}, {bits}) div 64 as int)").alias("g"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("v")).groupBy("g").agg(F.bit_or("v").alias("v"))
    table = [0] * (bits // 64)
    for g, v in groups.collect():
        table[g] = v
    return F.from_json(F.lit(json.dumps(table)), "array<bigint>"), bits


def bit_is_set(h: Column, table: Column, bits: int) -> Column:
    return F.getbit(F.get(table, F.expr("cast(0 as int)") + F.floor(F.pmod(h, F.lit(bits)) / 64).cast("int")), F.pmod(h, F.lit(64)).cast("int")) == 1


def screened(hashes: Column, table: Column, bits: int) -> Column:
    """(pos, h) of the hashes whose bit is set: all that the table was made from, and few others."""
    pairs = F.transform(hashes, lambda h, i: F.struct(i.alias("pos"), h.alias("h")))
    return F.filter(pairs, lambda p: bit_is_set(p["h"], table, bits))


def rows_with_hits(docs: DataFrame, k: int, table: Column, bits: int, least: int, single: tuple[Column, int] | None = None) -> DataFrame:
    """doc_id, key (of doc_id and text), sh, hits and a row id of the documents with ``least`` screened shingles or more, or with one of the table ``single``.

    The row id is made in the same projection as the hits: a projection that isn't deterministic keeps the optimizer
    from pushing the filter below it, where it would make the shingles again for every word.
    """
    split = docs.select("doc_id", row_key().alias("key"), words(F.col("text")).alias("w"))
    made = split.select("doc_id", "key", shingles(F.col("w"), k).alias("sh"))
    enough = F.size("hits") >= least
    if single is not None:
        enough = enough | F.exists("hits", lambda p: bit_is_set(p["h"], *single))
    return made.select("doc_id", "key", "sh", screened(F.col("sh"), table, bits).alias("hits"), F.monotonically_increasing_id().alias("rid")).filter(enough)
