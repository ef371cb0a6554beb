"""Judged retrieval: relevance, metrics, gates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

# Quality gates.
LEAST_RECALL, LEAST_MRR, LEAST_GAIN, MOST_FAMILY_LOSS = 0.85, 0.75, 1.10, 0.02
K = 10


#: Lines of a bin in which chunks and judgments of a file meet.
BIN_LINES = 64


def relevant(chunks: DataFrame, judgments: DataFrame) -> DataFrame:
    """query_id, chunk_id, grade: chunks that overlap the judged lines of their file.

    An interval join by bins: both sides are dealt over the bins of BIN_LINES lines that they touch and meet by (path, bin), so a long file with many
    judgments is no single group; a pair counts in the first bin that both touch.
    """
    def binned(rows: DataFrame, first: str, last: str) -> DataFrame:
        low, high = F.floor(F.col(first) / BIN_LINES), F.floor(F.col(last) / BIN_LINES)
        return rows.filter(F.col(last) >= F.col(first)).withColumn(f"{first}_bin", low).withColumn("bin", F.explode(F.sequence(low, high)))

    j = judgments.select("query_id", F.col("path").alias("relative_path"), F.col("start_line").alias("first"), F.col("end_line").alias("last"), F.col("relevance_grade").alias("grade"))
    c = chunks.select("chunk_id", "relative_path", "start_line", "end_line")
    both = binned(c, "start_line", "end_line").join(binned(j, "first", "last"), ["relative_path", "bin"])
    overlap = (F.col("end_line") >= F.col("first")) & (F.col("start_line") <= F.col("last")) & (F.col("bin") == F.greatest("start_line_bin", "first_bin"))
    return both.filter(overlap).groupBy("query_id", "chunk_id").agg(F.max("grade").alias("grade"))


def query_metrics(hits: DataFrame, relevance: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, recall, reciprocal_rank, ndcg at k.  hits: query_id, chunk_id, rank.  queries: query_id of all judged queries."""
    found = hits.filter(F.col("rank") <= k).join(relevance, ["query_id", "chunk_id"])
    got = found.groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = relevance.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("grade").alias("top"))
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + F.col("top") / F.log2(r + 1))
    out = queries.select("query_id").join(got, "query_id", "left").join(ideal, "query_id", "left")
    return out.select("query_id", F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.when(F.col("n") > 0, F.col("dcg") / best), F.lit(0.0)).alias("ndcg"))


def family_metrics(metrics: DataFrame, families: DataFrame) -> DataFrame:
    """Means by system and family.  metrics: system, query_id, ...; families: query_id, family."""
    return metrics.join(families, "query_id").groupBy("system", "family").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")))


def overall_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("system").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")))


def side_by_side(family: DataFrame) -> DataFrame:
    """family, baseline, candidate: nDCG of the two systems."""
    return family.groupBy("family").pivot("system", ["baseline", "candidate"]).agg(F.first("ndcg"))


def gates(overall: DataFrame, family: DataFrame) -> DataFrame:
    """One row of passed gates over systems baseline and candidate."""
    c = overall.filter("system = 'candidate'").select(F.col("recall"), F.col("reciprocal_rank"), F.col("ndcg"), F.lit(1).alias("_k"))
    b = overall.filter("system = 'baseline'").select(F.col("ndcg").alias("base"), F.lit(1).alias("_k"))
    loss = side_by_side(family).agg(F.max(F.col("baseline") - F.col("candidate")).alias("loss"), F.lit(1).alias("_k"))
    one = c.join(b, "_k").join(loss, "_k")
    return one.select((F.col("recall") >= LEAST_RECALL).alias("recall_ok"), (F.col("reciprocal_rank") >= LEAST_MRR).alias("mrr_ok"), (F.col("ndcg") >= F.col("base") * LEAST_GAIN).alias("gain_ok"), (F.col("loss") <= MOST_FAMILY_LOSS).alias("families_ok"))


#: Cells of a round of ``nearest_rank``, and values that are few enough to be sorted.
CELLS, SORTED = 4096, 10_000


def nearest_rank(rows: DataFrame, column: str, share: float) -> float | None:
    """The value of rank ceil(share * n) among the non-null values of a column; null if there is none.

    An order statistic by histograms: a round counts CELLS cells between the least and the greatest value that are left, and goes on in the cell that
    holds the rank, until SORTED values are left at most or all are equal.  No task or driver ever holds more.
    """
    left = rows.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    n, low, high = left.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    rank = max(1, math.ceil(share * n - 1e-9))
    while n > SORTED and low < high and (width := (high - low) / CELLS) > 0:
        cell = F.least(F.floor((F.col("v") - low) / width), F.lit(CELLS - 1)).cast("int")
        for c, k, a, z in sorted(left.groupBy(cell.alias("c")).agg(F.count(F.lit(1)), F.min("v"), F.max("v")).collect()):  # CELLS rows at most
            if rank <= k:
                break
            rank -= k
        n, low, high = k, a, z
        left = left.filter(F.col("v").between(a, z))
    if not n or low == high:
        return low
    return sorted(r[0] for r in left.collect())[rank - 1]


def throughput(timings: DataFrame) -> DataFrame:
    """files_per_s, chunks_per_s, p95_ms.  timings: file, ms, chunks; p95 by nearest rank."""
    p95 = nearest_rank(timings, "ms", 0.95)
    seconds = F.sum("ms") / 1000
    return timings.agg(F.round(F.count(F.lit(1)) / seconds, 6).alias("files_per_s"), F.round(F.sum("chunks") / seconds, 6).alias("chunks_per_s"), F.lit(p95).cast("double").alias("p95_ms"))
