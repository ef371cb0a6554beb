"""Next versions of keyed tables, schema evolution and table fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType


def upserted(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new lacks."""
    keys = [key] if isinstance(key, str) else key
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def files_replaced(chunks: DataFrame, new_chunks: DataFrame, files: DataFrame) -> DataFrame:
    """All chunks of the given files give way to new_chunks."""
    return chunks.join(files.select("file_id").distinct(), "file_id", "left_anti").unionByName(new_chunks)


def without(table: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """table without the rows that keys name; unknown and repeated keys do nothing."""
    on = [on] if isinstance(on, str) else on
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def source_removed(tables: dict[str, DataFrame], removed: DataFrame) -> dict[str, DataFrame]:
    """Every table (files, chunks, runs, profiles, dead letters) without the rows of removed sources (source_id).

    A table without source_id goes by job_id, through the ``runs`` that are removed.
    """
    gone = removed.select("source_id").distinct()
    jobs = tables["runs"].join(gone, "source_id", "left_semi").select("job_id") if "runs" in tables else None
    return {name: without(t, gone, "source_id") if "source_id" in t.columns else without(t, jobs, "job_id") for name, t in tables.items()}


def files_deleted(files: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) without the files that ``gone`` (source_id, relative_path) names; their chunks go with them."""
    ids = files.join(gone.select("source_id", "relative_path").distinct(), ["source_id", "relative_path"], "left_semi").select("file_id")
    return without(files, ids, "file_id"), without(chunks, ids, "file_id")


def evolved(table: DataFrame, schema: StructType, defaults: dict[str, object]) -> DataFrame:
    """table with the missing columns of schema, at their defaults; a column of another type is an error."""
    have = {f.name: f.dataType for f in table.schema.fields}
    wrong = [f.name for f in schema.fields if f.name in have and have[f.name] != f.dataType]
    if wrong:
        raise TypeError(f"columns of another type than declared: {', '.join(wrong)}")
    return table.select(*(F.col(f.name) if f.name in have else F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields), *(c for c in table.columns if c not in schema.names))


def with_provenance(chunks: DataFrame) -> DataFrame:
    """Rows from before structural chunking get the defaults they would have been given."""
    by_lines = F.concat(F.lit("lines:"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    # Provenance of older rows.
    given = {"chunk_kind": F.lit("text"), "structural_locator": by_lines, "chunker_id": F.lit("generic"), "chunker_version": F.lit("1"), "chunk_profile_fingerprint": F.lit("legacy-generic-1")}
    return chunks.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), v) for c, v in given.items()})


def corpus_fingerprint(files: DataFrame) -> DataFrame:
    """source_id, fingerprint: a hash over path-ordered hashes of the files, built up by hash of the path: 65,536 parts, 256 of these, all."""
    entry = F.sha2(F.concat_ws("\n", "relative_path", "content_hash").cast("binary"), 256)
    part = F.substring(F.sha2(F.col("relative_path").cast("binary"), 256), 1, 4)
    parts = files.groupBy("source_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("relative_path", entry.alias("h")))).alias("e"))
    parts = parts.select("source_id", "part", F.sha2(F.array_join(F.col("e.h"), "\n").cast("binary"), 256).alias("h"))
    for digits in (2, 0):
        joined = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "part", "h"))), "\n")
        parts = parts.groupBy("source_id", F.substring("part", 1, digits).alias("up")).agg(F.sha2(joined.cast("binary"), 256).alias("h")).withColumnRenamed("up", "part")
    return parts.select("source_id", F.col("h").alias("fingerprint"))
