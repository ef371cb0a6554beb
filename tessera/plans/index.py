"""Incremental indexing of a corpus: listing, diff, chunks, vectors, next versions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import content_hash, file_id
from ..operators.chunker import Limits, chunk_files
from ..operators.diff import KEYS, content_diff, listing_diff, run_totals, stale, to_embed
from ..sources import versions
from .embed import embedded

_FILES = "file_id string, source_id string, relative_path string, content_hash string, size_bytes long, modified long"
_VECTORS = "chunk_id string, file_id string, content_hash string, vector array<float>, embedding_profile_id string"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


@dataclass
class Pass:
    """What one pass did: counts of files, embeddings and upserts by source, how many chunks were embedded and removed in all, and the buckets written of each table."""

    totals: DataFrame
    embedded: int
    removed: int
    written: dict[str, list[int]]


def index_pass(spark: SparkSession, snapshot: DataFrame, base: str, fingerprint: str = "profile-1", limits: Limits = Limits(), force: bool = False, sources: DataFrame | None = None, buckets: int | None = None, **chunking) -> Pass:
    """Bring the tables under ``base`` (files, chunks, vectors) to the snapshot (source_id, relative_path, size_bytes, modified, text).

    Unchanged listings are settled without reading text; ids are content addresses, so a pass that is run again
    writes the same rows.  All tables are dealt over buckets by file_id: a pass reads and writes the buckets of the files that changed, and
    none if nothing did.  Vectors are published before chunks and files.  sources (source_id): those that the snapshot lists; files of
    others are neither compared nor removed.  chunking: further arguments of ``chunk_files``.
    """
    files = versions.read(spark, f"{base}/files") if versions.current(spark, f"{base}/files") else spark.createDataFrame([], _FILES)
    manifest = files if sources is None else files.join(sources.select("source_id").distinct(), "source_id", "left_semi")
    listing = listing_diff(snapshot, manifest, force)
    open_ = listing.filter(F.col("change").isin("new", "candidate"))
    known = files.select(*KEYS, F.col("file_id").alias("known"))
    texts = snapshot.join(open_.select(*KEYS), KEYS, "left_semi").withColumn("content_hash", content_hash(F.col("text")))
    texts = texts.join(known, KEYS, "left").withColumn("file_id", file_id(F.col("source_id"), F.col("relative_path"), F.col("known"))).drop("known")
    changes = versions.staged(content_diff(listing, texts.select(*KEYS, "content_hash"), files.select(*KEYS, "content_hash")), base)
    changed = changes.filter(F.col("change").isin("new", "changed")).select(*KEYS)
    new_chunks = versions.staged(chunk_files(texts.join(changed, KEYS, "left_semi").withColumnRenamed("text", "content"), fingerprint, limits, **chunking), base)
    gone = files.join(changes.filter(F.col("change") == "deleted").select(*KEYS), KEYS, "left_semi").select("file_id")
    settled = versions.staged(texts.select(*_names(_FILES)), base)
    touched = versions.staged(settled.join(changed, KEYS, "left_semi").select("file_id").unionByName(gone), base)
    before = versions.rows_of(spark, f"{base}/chunks", touched, "file_id", new_chunks.schema)
    added, dropped = versions.staged(to_embed(new_chunks, before), base), stale(new_chunks, before).count()
    made = added.select("chunk_id", "file_id", "content_hash").join(embedded(added.select("content_hash", "content")), "content_hash").select(*_names(_VECTORS))
    kept = versions.rows_of(spark, f"{base}/vectors", touched, "file_id", _VECTORS).join(new_chunks.select("chunk_id"), "chunk_id", "left_semi").select(*_names(_VECTORS))
    totals = versions.staged(run_totals(changes, added, new_chunks), base)
    gone = versions.staged(gone, base)
    written = {
        "vectors": versions.publish_changes(f"{base}/vectors", "file_id", versions.staged(kept.unionByName(made), base), touched, buckets),
        "chunks": versions.publish_changes(f"{base}/chunks", "file_id", new_chunks, touched, buckets),
        "files": versions.publish_changes(f"{base}/files", "file_id", settled, gone, buckets),
    }
    return Pass(totals, added.count(), dropped, written)
