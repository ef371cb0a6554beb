"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, mixture.

Edge cases, stage by stage: null and empty texts are scored like others by the quality classifier, are no near duplicates of anything, hold no
benchmark item and no secret, and have size 0 in the mixture; rows that repeat doc_id and text are one document from the
second stage on; documents without an id, or that share one, are judged each by its own text; columns of documents go through
unchanged, whatever their names, but for text (and n_chars) where a secret is masked; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import fold, stored, table, unused
from tessera.llm.decontaminate import drop_contaminated
from tessera.llm.jaccard import keep_one
from tessera.llm.mixing import mix_sources, mixture_digest
from tessera.llm.quality import fit_quality, labelled_rows, quality_scores
from tessera.llm.queries import QUALITY_THRESHOLD
from tessera.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows of its own input outside fold 0 of 5."""
    model = fit_quality(labelled_rows(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0))
    score = unused("_quality", docs.columns)
    return quality_scores(docs, model, score).filter(F.col(score) >= QUALITY_THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, that of the smallest id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets in its text are masked."""
    return redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes of every document: doc_id, size, source_size, target, taken, source."""
    return mixture_digest(mix_sources(docs))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixture", mixture)]
#: SQL can't express the classifier and the draws; tests/llm/test_pipeline.py holds the stages against what planted documents must come to.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
