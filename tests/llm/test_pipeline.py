"""The pipeline from end to end, and operators whose workers have no copy of the package."""

import random
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, jaccard, secrets

from .cases import SCHEMA, frame

REPO = Path(__file__).resolve().parents[2]


def _tables(spark, folder):
    r = random.Random(21)
    names = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    text = lambda k: " ".join(r.choices(names, k=k))
    rows = [(i, text(60) if i % 4 else " ".join(w + "***" for w in r.choices(names, k=60)), "en", f"s{i % 3}", 0, -5.0, "r", "h") for i in range(200)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(200)] + [(None, 1, 0), (5, None, 0), (900, 1, 0)]
    item = text(40)
    copy = rows[1][1].split()
    copy[30] = "changed"
    rows += [(300, " ".join(copy), "en", "s0", 0, -5.0, "r", "h"), (301, rows[2][1], "en", "s1", 0, -5.0, "r", "h"), (302, f"{text(20)} {item} {text(20)}", "en", "s2", 0, -5.0, "r", "h")]
    rows += [(303, f"{text(30)} password = abcdefgh1 {text(30)}", None, None, None, None, None, None), (304, None, None, "s0", None, None, None, None), (305, "", "en", None, 0, None, None, None), (None, text(60), None, "s1", None, -5.0, None, None), rows[3], rows[3], (306, text(4000), "en", "s1", 0, 0.0, "r", "h")]
    frame(spark, rows).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_pipeline(spark, tmp_path):
    rows = _tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "mixture":
            assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    kept = lambda name: sorted((str(r.doc_id), r.text or "") for r in seen[name])
    good = [r for r in rows if not (r[0] is not None and r[0] < 200 and r[0] % 4 == 0)]
    first = kept("quality")
    assert {x for x in first if x[1]} == {(str(r[0]), r[1]) for r in good if r[1]} and all(r.score in (-5.0, 0.0, None) for r in seen["quality"])
    # one document of each group: near copies, copies, repeated rows
    once = kept("near_duplicates")
    assert set(once) == set(first) - {("300", rows[200][1]), ("301", rows[201][1])} and len(once) == len(set(once))
    assert kept("decontamination") == [x for x in once if x[0] != "302"]
    assert kept("secrets") == sorted((i, t.replace("password = abcdefgh1", "[secret]")) for i, t in kept("decontamination"))
    size = {(str(r.doc_id), r.source): len((r.text or "").split()) for r in seen["secrets"]}
    assert {(str(r.doc_id), r.source): r.size for r in seen["mixture"]} == size
    assert all(r.taken <= 2 * r.size for r in seen["mixture"]) and sum(r.taken for r in seen["mixture"]) > sum(size.values())
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, seen["mixture"]))


def test_stages_on_an_empty_table(spark, tmp_path):
    _tables(spark, str(tmp_path))
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local-cluster[1,2,700]").config("spark.driver.memory", "700m").config("spark.executor.memory", "700m").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from tessera.llm import ann, langid, lm, quality
d = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("one two three"), F.col("id").cast("string"), F.lit("four five")).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"), (F.col("id") % 2).cast("int").alias("label"))
try:
    spark.range(1).rdd.map(lambda x: __import__("tessera").__name__).collect()
    print("IMPORTED")
except Exception:
    pass
print("LANG", langid.predict_language(d, langid.fit_language(d)).count())
print("QUALITY", quality.quality_scores(d, quality.fit_quality(d)).count())
print("LM", lm.score_texts(d.select("doc_id", "text"), F.lit(True)).count())
v = d.select(F.col("doc_id").alias("vec_id"), F.array(F.sin("doc_id"), F.cos("doc_id")).alias("embedding"))
print("NEAR", ann.nearest(v, F.col("vec_id") == 0, k=5).count())
spark.stop()
"""


def test_workers_need_no_package(tmp_path):
    script = SCRIPT.format(repo=str(REPO), shared=str(tmp_path / "shared"))
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env | {"PYSPARK_PYTHON": sys.executable}, capture_output=True, text=True, timeout=400)
    said = [x for x in out.stdout.splitlines() if x.split(" ")[0] in ("LANG", "QUALITY", "LM", "NEAR", "IMPORTED")]
    assert said == ["LANG 60", "QUALITY 60", "LM 60", "NEAR 5"], out.stdout[-2000:] + out.stderr[:3000] + out.stderr[-3000:]


def test_stage_parts_agree(spark):
    """The stages that drop rows drop what their operators find, row by row."""
    r = random.Random(22)
    d = frame(spark, [(i, " ".join(r.choices("abcdefgh", k=30)) if i % 3 else "same text of some words here", *[None] * 6) for i in range(30)])
    kept = jaccard.keep_one(d)
    groups = {x.component_id for x in jaccard.jaccard_components(d).collect()}
    assert sorted(x.doc_id for x in kept.collect()) == sorted(groups)
    assert decontaminate.drop_contaminated(d, spark.createDataFrame([(1, "same text of some words here")], "item_id long, text string")).count() == 20
    assert secrets.redact_secrets(d).filter(F.contains("text", F.lit("[secret]"))).count() == 0


def test_columns_of_any_name_go_through(spark, tmp_path):
    """Columns that are named like the stages' own helpers keep their values."""
    _tables(spark, str(tmp_path))
    names = ["_key", "_bad", "_quality", "score", "class", "key", "_KEY_", "rid", "label"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text", "source", *(F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}-clash")
        docs = spark.read.parquet(f"{tmp_path}/{name}-clash")
        assert docs.columns == ["doc_id", "text", "source", *names]
        rows = docs.collect()
        assert len(rows) > 100 and all(r[n] == f"{n}-{'none' if r.doc_id is None else r.doc_id}" for r in rows for n in names)
