"""Corpus and ledger tables derived from the given ones, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_EXT = "CASE doc_id % 8 WHEN 0 THEN '.md' WHEN 1 THEN '.cs' WHEN 2 THEN '.py' WHEN 3 THEN '.json' WHEN 4 THEN '.yaml' WHEN 5 THEN '.toml' WHEN 6 THEN '.xml' ELSE '.txt' END"
_PATH = f"lang || '/' || CAST(doc_id AS STRING) || {_EXT}"
_STATUS = "CASE event_id % 7 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Processing' WHEN 2 THEN 'RetryScheduled' WHEN 3 THEN 'Failed' WHEN 4 THEN 'Cancelled' ELSE 'Completed' END"
_CODE = "CASE event_id % 5 WHEN 0 THEN 'DependencyUnavailable' WHEN 1 THEN 'FileUnstable' WHEN 2 THEN 'SourceMissing' WHEN 3 THEN 'SchemaMismatch' ELSE 'Unexpected' END"

#: name: (table it is derived from, SELECT).
TABLES = {
    # the corpus as it was, and as it is: every tenth file edited, touched, deleted or new
    "files_old": ("documents", f"SELECT source AS source_id, {_PATH} AS relative_path, text AS content, n_chars AS size_bytes, doc_id * 60 AS modified FROM documents WHERE doc_id % 10 <> 3"),
    "files_new": ("documents", f"SELECT source AS source_id, {_PATH} AS relative_path, CASE WHEN doc_id % 10 = 1 THEN text || ' edited' ELSE text END AS content, CASE WHEN doc_id % 10 = 1 THEN n_chars + 7 ELSE n_chars END AS size_bytes, doc_id * 60 + CASE WHEN doc_id % 10 IN (1, 2) THEN 1 ELSE 0 END AS modified FROM documents WHERE doc_id % 10 <> 0"),
    "files": ("documents", f"SELECT doc_id, source AS source_id, {_PATH} AS relative_path, text AS content, n_chars AS size_bytes, doc_id * 60 AS modified FROM documents"),
    "chunks": ("documents", f"SELECT CAST(doc_id AS STRING) AS chunk_id, source AS source_id, CAST(doc_id - doc_id % 4 AS STRING) AS file_id, CAST(doc_id % 4 AS INT) AS ordinal, {_PATH} AS relative_path, lang AS language, text AS content, CAST(doc_id % 90 + 1 AS INT) AS start_line, CAST(doc_id % 90 + doc_id % 13 + 1 AS INT) AS end_line FROM documents"),
    "vectors": ("embeddings", "SELECT CAST(vec_id AS STRING) AS chunk_id, embedding AS vector, CASE WHEN label = 9 THEN 'other' ELSE 'main' END AS embedding_profile_id, label FROM embeddings"),
    "runs": ("events", f"SELECT CAST(event_id AS STRING) AS job_id, 's' || CAST(user_id % 40 AS STRING) AS source_id, event_id AS generation, {_STATUS} AS status, event_id * 37 AS requested, event_id * 37 + 90 AS completed, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id * 37 + 600 END AS next_attempt, event_id * 37 + 1200 AS lease_expires, CAST(event_id % 256 AS INT) AS cause_mask, CAST(event_id % 6 AS INT) AS attempt, {_CODE} AS code, CASE WHEN event_id % 11 = 0 THEN 'Odd' WHEN event_id % 3 = 0 THEN 'Failed' ELSE 'Succeeded' END AS outcome, event_id % 500 - 20 AS ms, event_id % 9 = 0 AS force, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'p' || CAST(event_id % 4 AS STRING) END AS target FROM events"),
    "sources": ("events", "SELECT DISTINCT 's' || CAST(user_id % 40 AS STRING) AS source_id, CASE WHEN user_id % 40 % 9 = 0 THEN 'Paused' WHEN user_id % 40 % 7 = 0 THEN 'Degraded' WHEN user_id % 40 % 5 = 0 THEN 'Indexing' ELSE 'Ready' END AS status, CASE WHEN user_id % 40 % 11 = 0 THEN 'Removing' ELSE 'Active' END AS lifecycle_state, user_id % 40 AS lifecycle_epoch, CASE WHEN user_id % 40 % 6 = 0 THEN NULL ELSE user_id % 40 * 1000 END AS last_success, '/data/root' || CAST(user_id % 40 AS STRING) AS root, CASE WHEN user_id % 40 % 7 = 0 THEN 'The registered source root is unavailable.' WHEN user_id % 40 % 5 = 0 THEN 'disk at /private/x' END AS last_error, user_id % 40 * 500 AS since FROM events"),
    "recovery": ("events", "SELECT DISTINCT 's' || CAST(user_id % 40 AS STRING) AS source_id, user_id % 40 AS desired_generation, user_id % 40 - user_id % 40 % 3 + CASE WHEN user_id % 40 = 39 THEN 5 ELSE 0 END AS completed_generation, CASE WHEN user_id % 40 % 8 = 0 THEN user_id % 40 END AS active_generation, CASE WHEN user_id % 40 % 4 = 0 THEN 'Running' WHEN user_id % 40 % 4 = 1 THEN 'Clean' WHEN user_id % 40 % 4 = 2 THEN 'Queued' ELSE 'Degraded' END AS state, CASE WHEN user_id % 40 % 4 = 3 THEN 'FileUnstable' END AS code FROM events WHERE user_id % 40 < 40 AND user_id % 2 = 1 OR user_id % 8 = 0"),
    "profiles": ("events", "SELECT DISTINCT 's' || CAST(user_id % 40 AS STRING) AS source_id, 'p' || CAST(user_id % 3 AS STRING) AS active_fingerprint, CASE WHEN user_id % 40 % 5 = 0 THEN 'p9' END AS pending_fingerprint, CASE WHEN user_id % 40 % 5 = 0 THEN 'Reindexing' WHEN user_id % 40 % 13 = 0 THEN 'Failed' ELSE 'Ready' END AS state FROM (SELECT user_id % 40 AS user_id FROM events) e WHERE user_id <> 17"),
    "pages_of": ("conversations", "SELECT conv_id AS doc, turn AS page, text FROM conversations"),
    "requests": ("benchmark", "SELECT CAST(item_id AS STRING) AS query_id, CASE WHEN item_id % 19 = 0 THEN '  ' ELSE text END AS query, CAST(CASE WHEN item_id % 17 = 0 THEN 0 ELSE 12 END AS INT) AS max_hits, CASE WHEN item_id % 13 = 0 THEN 1.5 ELSE 0.65 END AS alpha, CASE WHEN item_id % 11 = 0 THEN 'Fuzzy' WHEN item_id % 3 = 0 THEN 'Lexical' WHEN item_id % 3 = 1 THEN 'Vector' ELSE 'Hybrid' END AS mode, CASE WHEN item_id % 4 = 0 THEN 'EN' END AS language, CASE WHEN item_id % 7 = 0 THEN '../up' WHEN item_id % 6 = 0 THEN 'e' END AS path_prefix, CASE WHEN item_id % 20 = 3 THEN 'src1,nowhere' WHEN item_id % 5 < 2 THEN 'src1,src2,src3,src1' WHEN item_id % 25 = 7 THEN '' END AS scope FROM benchmark"),
}


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, select = TABLES[name]
    return spark.sql(select.replace(f"FROM {base}", "FROM {" + base + "}"), **{base: spark.read.parquet(f"{sf_dir}/{base}.parquet")})


def ctes(*names: str) -> str:
    """WITH clause of the named tables, for oracles."""
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n][1]})" for n in names)
