"""The opN_ queries: each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .ann import nearest
from .common import fold, table
from .decontaminate import find_contamination
from .jaccard import jaccard_components
from .langid import fit_language, predict_language
from .licenses import default_templates, oracle as license_oracle, scan_licenses
from .lm import score_texts
from .mixing import mix_sources, mixture_digest
from .quality import fit_quality, labelled_rows, quality_scores
from .ranked import rank_documents
from .secrets import scan_secrets
from .suffix import cut_repeats
from .tokencount import count_tokens
from .whitening import whiten


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), default_templates(spark))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_digest(mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language(docs.filter(fold("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    out = predict_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", 7) != 2)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


#: Documents scoring at least so much are predicted to be of quality 1.
QUALITY_THRESHOLD = 0.3


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(labelled_rows(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0))
    out = quality_scores(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # where the box keeps its vocabularies

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def s5_mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 fixes before it draws: doc_id, size, source_size, target."""
    mixture = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    both = mixture.sizes.join(mixture.sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return both.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def s7_lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that don't depend on the model."""
    return op7_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def s13_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns of op13: vec_id, n, deviation."""
    return op13_whitening(spark, sf_dir).filter(F.col("component") == 1).select("vec_id", "n", "deviation")


def s9_secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op9."""
    return op9_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Every window of op3 that has a shingle of an item, against all items of its size; shingles count as often as they occur.
DECONTAMINATION_SQL = r"""WITH i AS (SELECT row_number() OVER () AS q, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
z AS (SELECT q, item_id, w, len(w) AS m, least(len(w), 5) AS k FROM i WHERE len(w) > 0), e AS (SELECT q, m, k, p, w[p + 1:p + k] AS s FROM (SELECT *, unnest(range(m - k + 1)) AS p FROM z)),
b AS (SELECT r, k, n, p, w[p + 1:p + k] AS s FROM (SELECT r, w, k, len(w) - k + 1 AS n, unnest(range(len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM z) WHERE len(w) >= k)),
h AS (SELECT r, n, q, m, m - k + 1 AS span, b.p, e.p AS o, s FROM b JOIN e USING (k, s)), u AS (SELECT r, n, m, span, greatest(0, least(p - o, n - span)) AS a FROM h UNION SELECT r, n, m, span, greatest(0, least(p, n - span)) FROM h),
g AS (SELECT r, q, n, span, m, s, p, count(*) AS times FROM h GROUP BY ALL), c AS (SELECT r, q, m, span, n, a, s, least(count(*), any_value(times)) AS c FROM u JOIN g USING (r, n, m, span) WHERE p >= a AND p < a + span GROUP BY ALL),
v AS (SELECT r, q, m, a, sum(c)::BIGINT / (span + least(span, n) - sum(c)::BIGINT) AS similarity FROM c GROUP BY r, q, m, a, span, n)
SELECT doc_id, item_id, similarity, a::INT AS start_word, m::INT AS n_words FROM v JOIN d USING (r) JOIN z USING (q, m) WHERE similarity >= 0.75 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, a, m) = 1"""

#: Components of all pairs that share a shingle and link, by reachability.
JACCARD_SQL = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], chr(31)) for i in range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, chr(31))] ELSE [] END) AS g FROM d),
n AS (SELECT r, doc_id, len(g) AS n FROM s), u AS (SELECT r, hash(x) AS x FROM (SELECT r, unnest(g) AS x FROM s)),
h AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM u a JOIN u b ON a.x = b.x AND a.r < b.r GROUP BY ALL), k AS (SELECT a, b FROM h JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * common >= 75 * (p.n + q.n - common)), l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
c(r, t) AS (SELECT r, r FROM n UNION SELECT c.r, l.b FROM c JOIN l ON l.a = c.t)
SELECT n.doc_id, any_value(n.n)::BIGINT AS n_shingles, min(m.doc_id) AS component_id FROM c JOIN n ON n.r = c.r JOIN n m ON m.r = c.t GROUP BY n.r, n.doc_id"""

#: Every string of 200 bytes of every text, as hexadecimal digits, by how often it starts; then the covered bytes.
REPEATS_SQL = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT r, j, n, substr(h, 400 * j + 1, 798) AS h FROM (SELECT r, h, length(h) // 2 AS n, unnest(range(0, (length(h) // 2 + 199) // 200)) AS j FROM d)),
p AS (SELECT r, 200 * j + i AS i, hash(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, j, n, h, unnest(range(0, 200)) AS i FROM b) WHERE 200 * j + i + 200 <= n),
f AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1), e AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS step FROM p SEMI JOIN f USING (k)),
g AS (SELECT r, i, sum(CASE WHEN step <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS n FROM e), s AS (SELECT r, n, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY r, n),
k AS (SELECT r, n, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS b FROM s), t AS (SELECT r, sum(z - a) AS removed, count(*) AS spans, max(z) AS last FROM s GROUP BY r),
q AS (SELECT r, string_agg(substr(h, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS kept FROM k JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (r) LEFT JOIN q USING (r)"""

TARGETS_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, source, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')))::BIGINT AS size FROM documents GROUP BY ALL),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source), w AS (SELECT source, n, [3, 1, 2][(k % 3 + 1)::INT]::DOUBLE AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2 * n / w) AS pos, sum(n) OVER () AS total FROM w), l AS (SELECT *, (1.5 * total - coalesce(sum(2 * n) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT source, n, least(2 * n, w * max(level) OVER ()) AS target FROM l) SELECT doc_id, size, n AS source_size, round(target, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""".replace("RECURSIVE ", "")


#: CRC-32 of the id byte by byte, by the table of its polynomial; then words, with an empty one for each end.
LM_BASE_SQL = f"""WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, list_append({_WORDS}, '') AS w, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 7 = 2 AS held_out FROM documents, t),
k AS (SELECT r, unnest(w) AS x FROM d), c AS (SELECT x, count(*) FILTER (NOT held_out) AS c FROM k JOIN d USING (r) GROUP BY x), g AS (SELECT sum(c)::BIGINT AS n, count(*) FILTER (c > 0) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n) AS train_tokens, round(sum(log10((c + 1) / (n + v + 1))), 3) AS base_score FROM k JOIN c USING (x) JOIN d USING (r), g GROUP BY r, doc_id"""


def _spans_sql(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    """Leftmost matches of a pattern: what lies between them gives their places."""
    return f"""SELECT r, {order} AS o, '{kind}' AS kind, (list_sum(len_s[1:i]) + coalesce(list_sum(len_m[1:i-1]), 0))::BIGINT AS a, len_m[i] AS n FROM (SELECT r, len_s, len_m, len_g, unnest(range(1, len(len_m) + 1)) AS i FROM (SELECT r, list_transform(regexp_split_to_array(text, '{pattern}'), lambda x: length(x)) AS len_s, list_transform(regexp_extract_all(text, '{pattern}', 0), lambda x: length(x)) AS len_m, list_transform(regexp_extract_all(text, '{pattern}', {group}), lambda x: length(x)) AS len_g FROM d)) WHERE len_g[i] >= {least}"""


SECRETS_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), s AS ({_spans_sql('assign', 0, '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1, 6)} UNION ALL {_spans_sql('access', 1, 'AKIA[A-Z0-9]+', 0, 20)} UNION ALL {_spans_sql('hex', 2, '[0-9a-f]+', 0, 24)}),
j AS (SELECT r, count(*) FILTER (o = 0) AS n0, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) AS t FROM s GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(t, '')) AS base_sha256 FROM d LEFT JOIN j USING (r)"""


#: Every match of every document, joined on the term.
RANKED_SQL = r"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM t WHERE len(w) > 0), g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d), p AS (SELECT r, x, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS x FROM t) GROUP BY ALL),
f AS (SELECT x, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY x, docs),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark), u AS (SELECT q, item_id, unnest(w) AS x FROM i),
s AS (SELECT q, item_id, r, doc_id, sum(w * (1000000000 * tf // (1000 * tf + 20 * (50 + 50 * n * docs // terms))))::BIGINT AS score FROM u JOIN p USING (x) JOIN f USING (x) JOIN d USING (r), g GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50"""

#: What op13 fixes before it looks for components.
DEVIATION_SQL = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT + 100000) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
e AS (SELECT r, vec_id, unnest(x) AS x, unnest(range(len(x))) AS d FROM v), s AS (SELECT d, count(*)::BIGINT AS n, sum(x)::BIGINT AS s FROM e GROUP BY d)
SELECT vec_id, any_value(n) AS n, sum((n * x - s) * (n * x - s))::BIGINT AS deviation FROM e JOIN s USING (d) GROUP BY r, vec_id"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_license_scan, op2_jaccard_join, op3_decontamination, op4_suffix_dedup, op5_mixing, op6_language_id, op7_lm_scoring, op8_nearest_neighbours, op9_secret_scan, op10_quality, op11_token_counts, op12_ranked_search, op13_whitening, s5_mixing_targets, s7_lm_base, s9_secret_base, s13_deviation)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_oracle(), "op2_jaccard_join": JACCARD_SQL, "op3_decontamination": DECONTAMINATION_SQL, "op4_suffix_dedup": REPEATS_SQL, "s5_mixing_targets": TARGETS_SQL, "s7_lm_base": LM_BASE_SQL, "s9_secret_base": SECRETS_SQL, "op12_ranked_search": RANKED_SQL, "s13_deviation": DEVIATION_SQL}
