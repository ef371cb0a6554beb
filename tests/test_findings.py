"""What reviews found: odd tables, and work that grew too fast."""

import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.operators import blocks, chunker, lexical, search, sections


@pytest.fixture
def against_sql(spark, tmp_path):
    """The rows of a query and of its SQL over tables that are given as {name: (rows, schema)}."""

    def run(name, tables):
        con = duckdb.connect()
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got = queries.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
        return sorted(map(tuple, got.collect()), key=str), sorted(want, key=str)

    return run


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_breaks_of_chunks_without_content(against_sql):
    """Empty and missing texts break no rule that the SQL holds chunks to."""
    rows = [(0, "a", "en", "s", 1), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "   ", "en", "s", 3), (4, "b", "", "s", 1), (5, "b", "en", " ", 1), (9, "c", "en", "s", 1)]
    got, want = against_sql("c_constraint_breaks", {"documents": (rows, DOCUMENTS)})
    assert got == want and ("8", "ordinals") in got


def _search_tables(spark, n=400, queries=60):
    r = random.Random(7)
    names = [f"w{i}" for i in range(80)]
    text = lambda k: " ".join(r.choices(names, [1 / (i + 1) for i in range(80)], k=k))
    chunks = [(f"c{i}", "same words w1 w2" if i % 9 == 0 else text(r.randrange(3, 40)), f"s{i % 3}", ["en", "de"][i % 2], f"{'ab'[i % 2]}/{i}") for i in range(n)]
    asked = [(f"q{i}", text(r.choice([1, 4, 12])) if i % 5 else "same w1", ["s1"] if i % 7 == 0 else None, "EN" if i % 6 == 0 else None, None) for i in range(queries)]
    c = spark.createDataFrame(chunks, "chunk_id string, content string, source_id string, language string, relative_path string").repartition(5)
    return c, spark.createDataFrame(asked, "query_id string, query string, want_sources array<string>, want_language string, want_prefix string")


@pytest.mark.parametrize("long", [0, 250])
def test_queries_scored_together_are_those_scored_alone(spark, tmp_path, monkeypatch, long):
    """Many queries at once, with long lists as rows of a matrix or none, give what queries give one by one, equal texts in order of their ids."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 40)
    c, q = _search_tables(spark)
    index = lexical.store_index(c, str(tmp_path / "index"))
    monkeypatch.setattr(lexical, "TOGETHER", 1 << 30)
    want = sorted(map(tuple, lexical.lexical(q, index, 6).collect()))
    monkeypatch.setattr(lexical, "TOGETHER", 1)
    monkeypatch.setattr(lexical, "LONG_SHARE", long)
    assert sorted(map(tuple, lexical.lexical(q, index, 6).collect())) == want and len(want) > 300


def _vectors(spark, n=900):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(n, 8)).astype(np.float32)
    v[::10] = v[0]  # many equal vectors
    rows = [(f"c{i}", x.tolist(), "p") for i, x in enumerate(v)]
    want = []
    for i, s in enumerate(np.round(v[:n:3].astype(float) @ v.T.astype(float), 6)):
        order = sorted(range(n), key=lambda j: (-s[j], f"c{j}"))[:5]
        want += [(f"c{3 * i}", f"c{j}", s[j]) for j in order]
    return spark.createDataFrame(rows, "chunk_id string, vector array<float>, embedding_profile_id string").repartition(6), sorted(want)


def test_vector_search_by_a_pilot(spark, monkeypatch):
    """Many queries go by a pilot; equal vectors come in order of their ids."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 20)
    v, want = _vectors(spark)
    q = v.filter("cast(substr(chunk_id, 2) as int) % 3 = 0").withColumnRenamed("chunk_id", "query_id")
    for most in (1 << 17, 10):
        monkeypatch.setattr(search, "MANY_HITS", most)
        got = sorted((a, b, round(s, 6)) for a, b, s in search.vector(q, v, 5).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and max(abs(g[2] - w[2]) for g, w in zip(got, want)) < 2e-6


def test_a_task_sends_the_best_of_its_blocks_once(spark, monkeypatch):
    """What a search sends is bounded by queries and tasks, not by blocks of chunks."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 20)
    v, _ = _vectors(spark)
    q = v.filter("cast(substr(chunk_id, 2) as int) % 3 = 0").withColumnRenamed("chunk_id", "query_id").withColumn("least", F.lit(float("-inf")))
    q = q.select("query_id", F.col("vector").cast("array<double>").alias("q"), "embedding_profile_id", F.lit(8).alias("dim"), "least", *(F.lit(None).cast("array<string>" if w == "want_sources" else "string").alias(w) for w in blocks.FACTS.values()))
    keys = ("embedding_profile_id", "dim")
    packed, parts, total = blocks.query_blocks(q, F.lit(100), keys)
    pairs = blocks.met(search.packed_vectors(v).coalesce(2), packed, parts, total, 0, keys)
    sent = blocks.searched(pairs, search._read_vectors, lambda row, what, best: search._near(row, what, best, np.float32, False), 5, keys)
    assert sent.count() == 300 * 5 * 2


def _balanced(text):
    """By characters, as ``sections.balanced`` is defined."""
    open_, quote, shield = [], "", False
    for c in text:
        if quote:
            quote, shield = ("", False) if c == quote and not shield else (quote, c == "\\" and not shield)
        elif c == "#":
            break
        elif c in "'\"":
            quote, shield = c, False
        elif c in "[{":
            open_.append(c)
        elif c in "]}" and (not open_ or open_.pop() != {"]": "[", "}": "{"}[c]):
            return False
    return not quote and not open_


def test_balanced_values(spark):
    r = random.Random(5)
    values = ["".join(r.choices("[]{}'\"\\# ab\n", k=r.randrange(0, 9))) for _ in range(4000)] + ["[" * 300 + "]" * 300, "\"" + "\\\\" * 20_000 + "\"", "'\"' " * 20_000, "x" * 100_000 + "["]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", sections.balanced(F.col("v")).alias("b")).collect()
    assert [(x.v, x.b) for x in got] == [(v, _balanced(v)) for v in values]


def test_sections_read_every_text_once(spark):
    """One scan and one exchange of heads; characters are not folded one by one where a line has no bracket outside quotes."""
    d = spark.createDataFrame([("a", "a.toml", '[t]\nx = "1"')], "file_id string, relative_path string, content string")
    made = sections.sections(d.filter(~sections.malformed(d)))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and "Join" not in plan and made.count() == 1


def test_pieces_of_long_lines_take_one_pass():
    """The pieces are those that counting finds, and a long line isn't counted over and over."""
    r = random.Random(2)
    for _ in range(400):
        text = "".join(r.choices("ab \t\n\x1f\u00a0\u2003\u00e9", k=r.randrange(0, 60)))
        most = r.choice([3, 4, 9, 40])
        assert chunker.fitting(text, most) == chunker.fitting(text, most, lambda x: chunker.tokens(x))
    began = time.process_time()
    assert len(chunker.fitting("word " * 400_000, 90)) == 18_182 and time.process_time() - began < 1


def test_a_search_leaves_texts_where_they_lie(spark, monkeypatch):
    """Chunks meet the visible sources without an exchange of their texts, so no task holds a whole source; with a great many sources hits are the same."""
    c, q = _search_tables(spark, 60, 9)
    r = q.select("query_id", "query", F.col("want_sources").alias("source_ids"), F.lit(5).alias("limit"), F.lit(0.5).alias("alpha"), F.lit("Hybrid").alias("mode"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("path_prefix"))
    v = c.select("chunk_id", F.array(F.lit(1.0), F.length("content").cast("double")).alias("vector"), F.lit("p").alias("embedding_profile_id"))
    near = q.select("query_id", F.array(F.lit(1.0), F.lit(0.5)).alias("vector"), F.lit("p").alias("embedding_profile_id"))
    plans, store = [], search.store_index

    def stored(chunks, base):
        plans.append(chunks._jdf.queryExecution().executedPlan().toString())
        return store(chunks, base)

    monkeypatch.setattr(search, "store_index", stored)
    found, threshold = [], "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")
    for most in (100_000, 0):
        monkeypatch.setattr(search, "MANY_SOURCES", most, raising=False)
        found.append(sorted(map(tuple, search.search(r, c, v, near, c.select("source_id").distinct()).select("query_id", "chunk_id", "rank", "score").collect())))
    spark.conf.unset(threshold)
    assert found[0] == found[1] and len(found[0]) > 20 and "BroadcastHashJoin" in plans[0]
