"""Snapshot against manifest, and what follows for chunks and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEYS = ["source_id", "relative_path"]


def listing_diff(snapshot: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """new, candidate, unchanged or deleted by size and time alone; contents are not read.

    Both sides: source_id, relative_path, size_bytes, modified.
    """
    s = snapshot.select(*KEYS, F.col("size_bytes").alias("s_size"), F.col("modified").alias("s_modified"))
    m = manifest.select(*KEYS, F.col("size_bytes").alias("m_size"), F.col("modified").alias("m_modified"))
    same = (F.col("s_size") == F.col("m_size")) & (F.col("s_modified") == F.col("m_modified")) & F.lit(not force)
    kind = F.when(F.col("m_size").isNull(), "new").when(F.col("s_size").isNull(), "deleted").when(same, "unchanged").otherwise("candidate")
    return s.join(m, KEYS, "full_outer").select(*KEYS, kind.alias("change"))


def content_diff(listing: DataFrame, snapshot_hashes: DataFrame, manifest_hashes: DataFrame) -> DataFrame:
    """Candidates whose hash is the manifest's are only touched, others changed.  Both hash tables: source_id, relative_path, content_hash."""
    s = snapshot_hashes.withColumnRenamed("content_hash", "s_hash")
    m = manifest_hashes.withColumnRenamed("content_hash", "m_hash")
    out = listing.join(s, KEYS, "left").join(m, KEYS, "left")
    return out.select(*KEYS, F.when(F.col("change") != "candidate", F.col("change")).when(F.col("s_hash") == F.col("m_hash"), "touched").otherwise("changed").alias("change"))


def run_totals(changes: DataFrame, embedded: DataFrame | None = None, upserted: DataFrame | None = None) -> DataFrame:
    """Files by what happened to them, and the chunks embedded and upserted (tables with source_id), by source."""
    def count(*kinds: str) -> Column:
        return F.count_if(F.col("change").isin(*kinds))

    out = changes.groupBy("source_id").agg(count("new", "changed").alias("changed_files"), count("deleted").alias("deleted_files"), count("unchanged", "touched").alias("unchanged_files"))
    for name, rows in (("embeddings", embedded), ("upserts", upserted)):
        if rows is not None:
            out = out.join(rows.groupBy("source_id").agg(F.count(F.lit(1)).alias(name)), "source_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def to_embed(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Chunks that the previous version lacks."""
    return current.join(previous.select("chunk_id"), "chunk_id", "left_anti")


def stale(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Chunks of the previous version that are gone."""
    return previous.join(current.select("chunk_id"), "chunk_id", "left_anti")


def removed_by_path(stale_chunks: DataFrame) -> DataFrame:
    return stale_chunks.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("removed_chunks"))


def stability(first: DataFrame, second: DataFrame) -> DataFrame:
    """Files of two listings, marked FileUnstable where size or time moved or the file went."""
    b = second.select(*KEYS, F.col("size_bytes").alias("b_size"), F.col("modified").alias("b_modified"))
    moved = F.col("b_size").isNull() | (F.col("size_bytes") != F.col("b_size")) | (F.col("modified") != F.col("b_modified"))
    return first.join(b, KEYS, "left").select(*KEYS, F.when(moved, "FileUnstable").alias("failure"))
