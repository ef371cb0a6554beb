"""Operators of the library on small tables: the behaviours that searches, diffs, chunks and ledgers must have."""

import io
import json
import math
import random
import re
import time
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.functions import states, text as tx, vectors as vx
from tessera.operators import blocks, chunker, diff, evaluate, ledger, lexical, search, sections, tables
from tessera.plans.embed import accepted, compatible, embedded, hashing_encoder
from tessera.plans.index import index_pass
from tessera.plans.wordpiece import wordpiece
from tessera.schemas import CHUNKS
from tessera.sources import files, versions
from tessera.streaming import hints, timers


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_paths_and_languages(spark):
    d = spark.createDataFrame([("\\a\\B.CS",), ("x/Dockerfile",), ("node_modules/a.js",), (".ENV",), ("k/id.PEM",), ("a.b/c",), ("r.docx",)], "p string")
    got = [tuple(r) for r in d.select(tx.normalise_path(F.col("p")), tx.language_of(F.col("p")), tx.is_eligible(F.col("p"), F.lit(10)), tx.is_eligible(F.col("p"), F.lit(6 << 20))).collect()]
    assert got == [("a/B.CS", "csharp", True, False), ("x/Dockerfile", "text", True, False), ("node_modules/a.js", "javascript", False, False), (".ENV", "text", False, False), ("k/id.PEM", "text", False, False), ("a.b/c", "text", False, False), ("r.docx", "word", True, False)]


def test_requests_are_validated(spark):
    rows = [("q", 12, 0.5, "Hybrid", None, None, None), (" ", 12, 0.5, "Hybrid", None, None, "query"), ("q", 51, 0.5, "Hybrid", None, None, "limit"), ("q", 12, None, "Hybrid", None, None, "alpha"), ("q", 12, 0.5, "Any", None, None, "mode"), ("q", 12, 0.5, "Vector", "x" * 65, None, "language"), ("q", 12, 0.5, "Vector", None, "C:\\outside", "prefix"), ("q", 12, 0.5, "Vector", None, "a/../b", "prefix"), ("q", 12, 0.5, "Vector", None, "/abs", "prefix"), (None, 12, 0.5, "Vector", None, None, "query")]
    d = spark.createDataFrame(rows, "query string, limit int, alpha double, mode string, language string, path_prefix string, want string")
    assert [r.problem for r in search.validated(d).collect()] == [r[-1] for r in rows]


def test_vectors(spark):
    d = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,), ([0.6, 0.8],)], "v array<double>")
    assert [r[0] for r in d.select(vx.vector_problem(F.col("v"), 2)).collect()] == ["norm", "norm", "finite", "dimension", "dimension", None]
    assert [r[0] for r in d.limit(2).select(vx.l2_normalised(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def _units(path, text, **limits):
    return chunker.chunk_text(path, text, chunker.Limits(**limits) if limits else chunker.Limits())


def test_brace_languages():
    name, outcome, rows = _units("a.cs", "using X;\n\nnamespace N.M;\n\npublic class A\n{\n    public void Run(int x)\n    {\n        var s = \"}\"; // }\n    }\n}\n")
    assert (name, outcome) == ("csharp", "structural")
    named = {(r[0], r[1], r[2], r[5], r[6]) for r in rows if r[1]}
    assert ("class", "A", "N.M.A", 4, 11) in named and ("member", "Run", "N.M.A.Run", 7, 10) in named
    assert any(r[0] == "text" and "using X" in r[4] for r in rows)
    assert _units("a.cs", "class A { \"open")[1] == "invalid-or-malformed"
    assert _units("a.ts", "export function go(a) {\n  return a;\n}\nconst f = (x) => {\n  return `}`;\n}\n")[2][0][1] == "go"
    assert _units("a.cs", "/* x */ class A {\n}\n")[2][0][0] == "csharp"  # a comment in front hides the declaration
    assert _units("a.cs", "// only a comment\n")[2][0][0] == "csharp"
    assert _units("a.go", "func main() {}")[:2] == ("generic", "unsupported")


def test_python_and_xml():
    text = 'import os\n\nclass A(B):\n    """def no(): pass"""\n    def f(self, x):\n        return 1\n\ndef g():\n    pass'
    named = {(r[1], r[2], r[5], r[6]) for r in _units("a.py", text)[2] if r[1]}
    assert named == {("A", "A", 3, 7), ("f", "A.f", 5, 7), ("g", "g", 8, 9)}
    for broken in ("def f(:\n  pass", "\tx = 1", "s = 'open", "class :"):
        assert _units("a.py", broken)[1] == "invalid-or-malformed"
    rows = _units("a.xml", "<r>\n<a>1</a>\n<b/>\n</r>")[2]
    assert [(r[0], r[2], r[5], r[6]) for r in rows] == [("text", None, 1, 1), ("element", "r.a", 2, 2), ("element", "r.b", 3, 4)]
    assert _units("a.xml", "<r><a/><b/></r>")[1] == "invalid-or-malformed"  # siblings on a line
    assert _units("a.xml", "<r>")[1] == "invalid-or-malformed" and _units("a.xml", "<!DOCTYPE x><r/>")[1] == "invalid-or-malformed"


@pytest.mark.parametrize("bad", [lambda x: [chunker.Unit("k", None, None, "l", 0, 1)], lambda x: [chunker.Unit("k", None, None, "l", 1, 1)] * 2, lambda x: None, lambda x: 1 / 0])
def test_faulty_adapters_fall_back_whole(bad):
    name, outcome, rows = chunker.chunk_text("a.zz", "one\ntwo", chunker.Limits(), {"zz": ((".zz",), bad)})
    assert name == "generic" and outcome != "structural" and rows[0][3].startswith("lines:") and "".join(r[4] for r in rows) == "one\ntwo"


def test_generic_windows_and_oversize():
    rows = chunker.generic(["aaa", "bbb", "ccc", "", "ddd"], chunker.Limits(4, 9, 8))
    assert rows[0][0] == "lines:1-2" and rows[1][0].startswith("lines:2-") and all(chunker.tokens(r[1]) <= 9 for r in rows)
    long = chunker.generic(["x" * 20], chunker.Limits(5, 9, 0))
    assert "".join(r[1] for r in long) == "x" * 20 and [r[0][-1] for r in long] == ["1", "2", "3"]
    text = "class A\n{\n" + "\n".join(f"    int field{i};" for i in range(30)) + "\n}\n"
    rows = _units("a.cs", text, target=20, most=24)[2]
    assert all(chunker.tokens(r[4]) <= 24 for r in rows) and {r[0] for r in rows} == {"class", "class-continuation"} and all(":segment:" in r[3] for r in rows)


def test_chunk_rows_are_stable_and_valid(spark):
    d = spark.createDataFrame([("s", "f1", "a.py", "def f():\n  pass"), ("s", "f2", "b.txt", None), ("s", "f3", "c.cs", "x\ny")], "source_id string, file_id string, relative_path string, content string")
    a, b = (chunker.chunk_files(x, "p").orderBy("chunk_id").collect() for x in (d, d.repartition(3)))
    assert a == b and {r.file_id for r in a} == {"f1", "f3"}
    assert sections.chunk_violations(chunker.chunk_files(d, "p"), 480).count() == 0
    assert sections.chunk_violations(chunker.chunk_files(d, "p").withColumn("ordinal", F.lit(1)), 480).count() > 0


def test_sections(spark):
    cases = {"a.md": "intro\n# A\n## B\nx\n# C #\n", "b.md": "plain", "c.json": '{\n  "k": 1,\n  "l": {\n    "m": 2\n  }\n}', "d.yaml": "k: 1\nl:\n  - a: 2\n", "e.toml": "[t]\nx = 1\n[[u]]\n", "f.json": "{", "g.yaml": "k: 'open", "h.yaml": "just text", "i.toml": "x = [1", "j.yaml": "\tk: 1", "k.yaml": "k: [a, {b: c}] # ]", "l.toml": "nothing"}
    d = spark.createDataFrame([(k, k, v) for k, v in cases.items()], "file_id string, relative_path string, content string")
    bad = {r.file_id for r in d.filter(sections.malformed(d)).collect()}
    assert bad == {"f.json", "g.yaml", "h.yaml", "i.toml", "j.yaml", "l.toml"}
    u = sections.ordered(sections.sections(d.filter(~sections.malformed(d))))
    got = {(r.file_id, r.ordinal): (r.kind, r.qualified, r.start_line, r.end_line) for r in u.collect()}
    assert [got["a.md", i] for i in range(4)] == [("section", None, 1, 1), ("section", "A", 2, 2), ("section", "A / B", 3, 4), ("section", "C", 5, 6)]
    assert got["b.md", 0] == ("section", None, 1, 1) and got["c.json", 1] == ("property", "l", 3, 6) and got["d.yaml", 1] == ("key", "l", 2, 4) and got["e.toml", 1] == ("table", "u", 3, 4)
    g = {r.file_id: (r.start_line, r.end_line) for r in sections.gaps(d.filter("file_id = 'c.json'"), u).collect()}
    assert g == {"c.json": (1, 1)}
    assert sections.invalid_files(d, u).count() == 0
    assert sections.invalid_files(d, u.withColumn("end_line", F.lit(99))).count() > 0


def test_sections_in_files_are_those_of_the_operations(spark):
    cases = {"a.md": "intro\n# A\n### B\nx\n## C #\n\n#\n# D", "b.md": "plain\n\ntext", "c.md": "\n\n# A", "d.md": "", "c.json": '{\n  "k": 1,\n  "l": {\n    "m": 2\n  }\n}', "d.json": "[1,\n2]", "d.yaml": "k: 1\n# x\nl:\n  - a: 2\n", "e.yaml": "# only", "f.yml": "---\nk: [a, {b: c}] # ]", "e.toml": "# c\n[t]\nx = 1\n[[u]]\n", "f.toml": "x = 1", "g.json": "{", "g.yaml": "k: 'open", "h.yaml": "just text", "i.toml": "x = [1", "j.yaml": "\tk: 1", "k.json": '{"x": NaN}'}
    d = spark.createDataFrame([(k, k, v) for k, v in cases.items()], "file_id string, relative_path string, content string")
    good = d.filter(~sections.malformed(d))
    u = sections.sections(good)
    want = {}
    for r in u.unionByName(sections.gaps(good, u)).collect():
        want.setdefault(r.file_id, set()).add(tuple(r)[1:])
    for name, text in cases.items():
        units = chunker.ADAPTERS[sections_of(name)][1](text.split("\n"))
        got = None if units is None else {(x.kind, x.symbol, x.qualified, x.locator, x.start, x.end) for x in units}
        assert got == (None if name in ("g.json", "g.yaml", "h.yaml", "i.toml", "j.yaml", "k.json") else want.get(name, set())), name


def sections_of(name):
    return {"md": "markdown", "yml": "yaml"}.get(name.split(".")[1], name.split(".")[1])


def test_declaration_quirks():
    # blank and comment lines before a declaration belong to it; a type token makes any call-like head a member
    rows = _units("a.cs", "using X;\n\n// note\npublic class A\n{\n    Dictionary<string, int> Run(int x)\n    {\n        else if (y) {\n        }\n    }\n}")[2]
    assert [(r[1], r[2], r[5], r[6]) for r in rows] == [(None, None, 1, 3), ("A", "A", 4, 11), ("Run", "A.Run", 6, 10), ("if", "A.Run.if", 8, 9)]
    assert [(r[0], r[1], r[5], r[6]) for r in _units("a.ts", "const f = ({a}) => {\n  return a;\n}")[2]] == [("member", "f", 1, 1), ("text", None, 2, 3)]
    assert _units("a.cs", "interface I { int P { get; } }")[2][0][:3] == ("interface", "I", "I")
    assert _units("a.cs", 'class A { string s = "\\\n"; }')[1] == "structural"
    text = "class A:\n    def f(self):\n        x = 1\n\n        def g():\n            pass\n    y = 2\nasync def h() -> int:  # c\n    pass\n"
    assert [(r[2], r[5], r[6]) for r in _units("a.py", text)[2]] == [("A", 1, 7), ("A.f", 2, 6), ("A.f.g", 5, 6), ("h", 8, 10)]
    assert _units("a.py", "x = 'a\\\nb'")[1] == "invalid-or-malformed"


def test_other_token_counters(spark):
    words = lambda text: len(text.split())
    text = "\n".join(f"line {i} of words" for i in range(20)) + "\n" + "w " * 30
    for path in ("a.txt", "a.md"):
        rows = chunker.chunk_text(path, text, chunker.Limits(6, 9, 0), count=words)[2]
        assert len(rows) > 9 and all(words(r[4]) <= 9 for r in rows) and "".join("".join(r[4].split()) for r in rows) == "".join(text.split())
    chunker.register_chunk_table(spark)
    spark.createDataFrame([("a.py", "def f():\n  pass"), ("b.txt", None)], "path string, text string").createOrReplaceTempView("some_files")
    got = spark.sql("SELECT path, c.chunker_id, c.symbol_name FROM some_files, LATERAL chunk_text(path, text) c").collect()
    assert [tuple(r) for r in got] == [("a.py", "python", "f")]


def test_extractors(spark, tmp_path):
    (tmp_path / "a.md").write_text("x\r\ny")
    (tmp_path / "b.py").write_bytes(b"\xff")
    found = files.scan(spark, str(tmp_path), "s")
    own = {"upper": ([".md"], lambda data: data.decode().upper())}
    assert {r.relative_path: (r.text, r.error) for r in files.extracted(found, own).collect()} == {"a.md": ("X\nY", None), "b.py": (None, "Unsupported")}
    assert {r.relative_path for r in files.extracted(found).collect()} == {"a.md", "b.py"}
    with pytest.raises(ValueError):
        files.extracted(found, {**own, "again": ([".md"], bytes.decode)})


def test_report(spark, tmp_path):
    versions.write_report(spark.createDataFrame([("all", 0.5)], "family string, recall double"), str(tmp_path / "r"))
    assert one(spark.read.json(str(tmp_path / "r"))).recall == 0.5


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("BROADCAST_BYTES", 0), ("QUERY_BYTES", 600), ("PART_BYTES", 2000), ("BLOCK_ROWS", 7), ("KNOWN", 2)):
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(lexical, "PILOT", 3)


def test_vector_search_in_blocks(spark, request):
    rows = [(f"c{i}", [float(i % 7), float(i % 5)], "p" if i % 4 else "q") for i in range(60)] + [("none", None, "p"), ("odd", [1.0], "p"), ("part", [1.0, None], "p"), ("lost", [1.0, 2.0], None)]
    v = spark.createDataFrame(rows, "chunk_id string, vector array<float>, embedding_profile_id string").repartition(3)
    q = v.withColumnRenamed("chunk_id", "query_id")
    real = [r for r in rows if r[1] and None not in r[1] and r[2]]
    want = []
    for i, a, p in real:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b, o in real if o == p and len(b) == len(a) and j != i)
        want += [(i, j, -s) for s, j in scored[:4]]
    assert sorted(map(tuple, search.vector(q, v, pool=4, exclude_self=True).collect())) == sorted(want) and len(want) == 240
    request.getfixturevalue("small_blocks")
    assert sorted(map(tuple, search.vector(q, v, pool=4, exclude_self=True).collect())) == sorted(want)
    plans = [search.vector(q.limit(n), v)._jdf.queryExecution().optimizedPlan().toString().count("Join") for n in (1, 60)]
    assert plans == [1, 1]  # the plan is the same for any number of queries
    assert search.vector(q.limit(0), v).count() == search.vector(q, v.limit(0)).count() == 0


def _bm25(chunks, queries, pool):
    """queries: (id, text, sources, language, prefix); chunks: (id, text, source, language, path)."""
    bags = {c[0]: Counter(re.findall(r"[^\W_]+", f"{c[4]} {c[3] or ''} {c[1]}".lower())) for c in chunks}
    df = Counter(t for b in bags.values() for t in b)
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    out = []
    for q, text, sources, language, prefix in queries:
        scored = []
        for i, _, source, own, path in chunks:
            b, n = bags[i], sum(bags[i].values())
            hit = [t for t in set(re.findall(r"[^\W_]+", text.lower())) if t in b]
            if not hit or sources is not None and source not in sources or language and (own or "").lower() != language.lower() or prefix and not path.lower().startswith(prefix.lower()):
                continue
            s = sum(math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * n / mean)) for t in hit)
            scored.append((-round(s, 6), i))
        out += [(q, i, -s) for s, i in sorted(scored)[:pool]]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_lexical_search(spark, tmp_path, request, small):
    """The stored index, searched with thresholds from a pilot and lists that are left early, gives what all sums give."""
    if small:
        request.getfixturevalue("small_blocks")
    r = random.Random(4)
    names = [f"t{i}" for i in range(60)]
    text = lambda k: " ".join(r.choices(names, [1 / (i + 1) for i in range(60)], k=k))
    chunks = [(f"c{i}", text(r.randrange(1, 60)), f"s{i % 4}", ["en", "DE", None][i % 3], f"{'ab'[i % 2]}/x{i}.md") for i in range(150)] + [("empty", "", "s0", "en", "q"), *((f"copy{i}", "t1 t2 t3", "s1", "en", "z") for i in range(30))]
    queries = [(f"q{i}", text(r.choice([1, 3, 12])), None, None, None) for i in range(12)] + [("src", "t1 t2 t9", ["s1", "s2"], None, None), ("no", "t1", [], None, None), ("lang", "t0 t4", None, "de", None), ("path", "t0 t5 t6", ["s1", "s3"], None, "B/"), ("none", "absent", None, None, None), ("blank", " ", None, None, None)]
    c = spark.createDataFrame([(*x, i) for i, x in enumerate(chunks)], "chunk_id string, content string, source_id string, language string, relative_path string, ordinal int").repartition(3)
    q = spark.createDataFrame(queries, "query_id string, query string, want_sources array<string>, want_language string, want_prefix string")
    index = lexical.store_index(c, str(tmp_path / "index"))
    assert index.chunks == len(chunks) and (index.pilots > 0 or not small)
    for pool in (5, 50):
        assert sorted(map(tuple, lexical.lexical(q, index, pool).collect())) == _bm25(chunks, queries, pool)
    again = lexical.open_index(spark, str(tmp_path / "index"))
    assert lexical.lexical(q.select("query_id", "query"), again, 5).count() > 0 and again.mean == index.mean
    assert lexical.lexical(q, lexical.store_index(c.limit(0), str(tmp_path / "none"))).count() == 0


def test_lists_are_left_early():
    """Once no other chunk can reach the threshold, long lists are only looked up."""
    n, r = 4000, np.random.default_rng(1)
    lists = [(np.array([5, 9]), np.array([1.0, 0.9])), (np.arange(n), r.uniform(0.1, 0.2, n)), (np.arange(n), r.uniform(0.1, 0.2, n))]
    idf = np.array([9.0, 0.1, 0.1])
    at, score = lexical._best(lists, idf, np.array([9.0, 0.02, 0.02]), n, 8.0, None, 2)
    assert at.tolist() == [5, 9] and abs(score[0] - (9 + 0.1 * (lists[1][1][5] + lists[2][1][5]))) < 1e-5
    assert lexical._best(lists, idf, np.array([9.0, 0.02, 0.02]), n, 9.1, None, 2) is None


def test_section_families_are_chunked(spark):
    long = "\n".join("word " * 6 for _ in range(12))
    cases = {"a.md": f"intro\n# A\n## B\n{long}\n# C\nend", "b.json": '{\n  "k": 1,\n  "l": 2\n}', "c.yaml": "# note\nk: 1\nl:\n  - a: 2", "d.yml": "\tx", "e.toml": "[t]\r\nx = 1\r\n[[u]]\r\ny = 2", "f.json": "{", "g.toml": "x = [1", "h.md": None, "i.txt": "x", "j.md": "# A\nx\n# A\ny"}
    d = spark.createDataFrame([("s", k, k, v) for k, v in cases.items()], "source_id string, file_id string, relative_path string, content string")
    limits = chunker.Limits(60, 90, 16)
    rows = chunker.chunk_files(d, "p", limits)
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r.file_id, r.ordinal)):
        got.setdefault(r.file_id, []).append(r)
    ids = {k: {(r.chunker_id, r.outcome) for r in v} for k, v in got.items()}
    bad = {("generic", "invalid-or-malformed")}
    assert ids == {"a.md": {("markdown", "structural")}, "b.json": {("json", "structural")}, "c.yaml": {("yaml", "structural")}, "d.yml": bad, "e.toml": {("toml", "structural")}, "f.json": bad, "g.toml": bad, "i.txt": {("generic", "unsupported")}, "j.md": {("markdown", "structural")}}
    spans = {k: [(r.chunk_kind, r.qualified_symbol_name, r.start_line, r.end_line) for r in v] for k, v in got.items()}
    assert spans["b.json"] == [("text", None, 1, 1), ("property", "k", 2, 2), ("property", "l", 3, 4)]
    assert spans["c.yaml"] == [("text", None, 1, 1), ("key", "k", 2, 2), ("key", "l", 3, 4)] and spans["e.toml"] == [("table", "t", 1, 2), ("table", "u", 3, 4)]
    # whole-file brute force for Markdown: every line is in one piece, large sections go on as continuations
    md = got["a.md"]
    assert [r.chunk_kind for r in md] == ["section", "section", *["section"], *["section-continuation"] * (len(md) - 4), "section"] and len(md) > 5
    assert "\n".join(r.content for r in md) == cases["a.md"] and {r.qualified_symbol_name for r in md} == {None, "A", "A / B", "C"}
    assert sections.chunk_violations(rows, limits.most).count() == 0


def test_diff_and_upsert(spark):
    cols = "source_id string, relative_path string, size_bytes long, modified long"
    old = spark.createDataFrame([("s", "a", 1, 1), ("s", "b", 1, 1), ("s", "c", 1, 1)], cols)
    new = spark.createDataFrame([("s", "a", 1, 1), ("s", "b", 2, 1), ("s", "d", 1, 1)], cols)
    assert {(r.relative_path, r.change) for r in diff.listing_diff(new, old).collect()} == {("a", "unchanged"), ("b", "candidate"), ("c", "deleted"), ("d", "new")}
    assert diff.listing_diff(new, old, force=True).filter("change = 'unchanged'").count() == 0
    assert {r.relative_path for r in diff.stability(old, new).filter("failure is not null").collect()} == {"b", "c"}
    assert sorted(r.size_bytes for r in tables.upserted(old, new, ["source_id", "relative_path"]).collect()) == [1, 1, 1, 2]


def test_schema_evolves_by_addition_only(spark):
    d = spark.createDataFrame([("c", 1, 2)], "chunk_id string, start_line int, end_line int")
    row = one(tables.with_provenance(tables.evolved(d, CHUNKS, {"chunk_kind": ""})))
    assert (row.chunk_kind, row.structural_locator, row.chunk_profile_fingerprint) == ("text", "lines:1-2", "legacy-generic-1")
    with pytest.raises(TypeError):
        tables.evolved(d.withColumn("start_line", F.lit("x")), CHUNKS, {})


def _corpus(spark, texts):
    return spark.createDataFrame([("s", p, len(t), m, t) for p, (t, m) in texts.items()], "source_id string, relative_path string, size_bytes long, modified long, text string")


def test_index_passes_converge(spark, tmp_path):
    texts = {f"f{i}.txt": (f"text number {i}", 1) for i in range(64)}
    first = index_pass(spark, _corpus(spark, texts), str(tmp_path))
    assert first.embedded == 64 and one(first.totals).changed_files == 64
    again = index_pass(spark, _corpus(spark, texts), str(tmp_path))
    assert (again.embedded, again.removed, one(again.totals).unchanged_files) == (0, 0, 64)
    texts["f1.txt"] = ("another text", 2)
    texts["f2.txt"] = (texts["f2.txt"][0], 2)
    del texts["f3.txt"]
    third = index_pass(spark, _corpus(spark, texts), str(tmp_path))
    assert (third.embedded, third.removed) == (1, 2)
    t = one(third.totals)
    assert (t.changed_files, t.deleted_files, t.unchanged_files) == (1, 1, 62)
    assert versions.read(spark, f"{tmp_path}/chunks").count() == versions.read(spark, f"{tmp_path}/vectors").count() == 63
    assert versions.read(spark, f"{tmp_path}/chunks", 1).count() == 64  # a pinned version stays


def _folders(base):
    return {t: {str(p.relative_to(base / t)) for p in (base / t / "data").glob("*/_bucket=*")} for t in ("files", "chunks", "vectors")}


def test_a_pass_writes_what_it_touches(spark, tmp_path):
    texts = {f"f{i}.txt": (f"text number {i}", 1) for i in range(64)}
    first = index_pass(spark, _corpus(spark, texts), str(tmp_path), buckets=8)
    before, pinned = _folders(tmp_path), [versions.current(spark, f"{tmp_path}/{t}") for t in ("files", "chunks", "vectors")]
    assert first.written == {t: list(range(8)) for t in ("files", "chunks", "vectors")} and pinned == [1, 1, 1]
    again = index_pass(spark, _corpus(spark, texts), str(tmp_path))
    assert again.written == {"files": [], "chunks": [], "vectors": []} and _folders(tmp_path) == before
    assert [versions.current(spark, f"{tmp_path}/{t}") for t in ("files", "chunks", "vectors")] == pinned
    texts["f7.txt"] = ("text number seven", 2)
    third = index_pass(spark, _corpus(spark, texts), str(tmp_path))
    new = {t: f - before[t] for t, f in _folders(tmp_path).items()}
    assert all(len(third.written[t]) == 1 and [x[-1] for x in new[t]] == [str(third.written[t][0])] for t in new)
    texts["f8.txt"] = (texts["f8.txt"][0], 3)  # touched only: the listing changes, chunks and vectors stay
    fourth = index_pass(spark, _corpus(spark, texts), str(tmp_path))
    assert len(fourth.written["files"]) == 1 and fourth.written["chunks"] == fourth.written["vectors"] == []
    assert {r.modified for r in versions.read(spark, f"{tmp_path}/files").collect()} == {1, 2, 3}
    assert {r.content for r in versions.read(spark, f"{tmp_path}/chunks").collect()} == {t for t, _ in texts.values()}
    assert {r.content for r in versions.read(spark, f"{tmp_path}/chunks", 1).collect()} == {f"text number {i}" for i in range(64)}


def test_bucketed_versions(spark, tmp_path):
    base = str(tmp_path / "t")
    rows = lambda ids, v: spark.createDataFrame([(f"k{i}", v) for i in ids], "k string, v int")
    none = rows([], 0)
    assert versions.publish_changes(base, "k", rows(range(40), 1), none, buckets=4) == [0, 1, 2, 3]
    state = lambda n=None: {r.k: r.v for r in versions.read(spark, base, n).collect()}
    # a writer that breaks off before it points to its version leaves readers where they are, and the next one goes on
    versions._written(rows([1], 9), base, "k", 4)
    spark.createDataFrame([(0, "nowhere", 1, 4)], versions.MANIFEST).write.json(f"{base}/_manifest/v=2")
    assert state() == {f"k{i}": 1 for i in range(40)}
    versions.publish_changes(base, "k", rows([1, 50], 2), rows([2, 99], 0))
    assert versions.current(spark, base) == 3 and state() == {f"k{i}": 1 for i in range(40) if i not in (1, 2)} | {"k1": 2, "k50": 2} and len(state(1)) == 40
    # a writer whose version has been overtaken fails instead of undoing the other's work
    with pytest.raises(versions.Conflict):
        versions._publish(spark, base, 1, 4, {})
    assert versions.rebucketed(spark, base, "k", 7) > 3 and len(state()) == 40 and versions.manifest(spark, base)[1] == 7
    whole = state()
    assert versions.vacuum(spark, base, keep=1) > 0 and state() == whole and versions.vacuum(spark, base, keep=1) == 0
    assert versions.publish_changes(base, "k", none, versions.read(spark, base)) == list(range(7)) and state() == {}
    versions.publish_changes(base, "k", rows([5], 5), none)
    assert state() == {"k5": 5}
    # tables in one folder a version: two writers never share a number
    assert [versions.publish(rows([i], i), str(tmp_path / "w")) for i in range(2)] == [1, 2]
    rows([8], 8).write.parquet(f"{tmp_path}/w/v=3")
    assert versions.publish(rows([9], 9), str(tmp_path / "w")) == 4 and versions.read(spark, str(tmp_path / "w")).first().v == 9


def test_file_scan_and_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "bin").mkdir()
    (tmp_path / "sub/a.py").write_bytes(b"\xef\xbb\xbfx\r\ny\rz")
    (tmp_path / "bin/b.py").write_text("no")
    (tmp_path / ".env").write_text("no")
    buf = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p></w:document>')
        z.writestr("word/header1.xml", f'<w:hdr xmlns:w="{w}"><w:p><w:r><w:t>head</w:t></w:r></w:p></w:hdr>')
    (tmp_path / "d.docx").write_bytes(buf.getvalue())
    (tmp_path / "e.docx").write_bytes(b"broken")
    found = files.scan(spark, str(tmp_path), "s")
    assert {r.relative_path for r in found.select("relative_path").collect()} == {"sub/a.py", "d.docx", "e.docx"}
    assert one(files.plain_texts(found)).text == "x\ny\nz"
    docs = {r.relative_path: (r.text, r.error) for r in files.docx_texts(found).collect()}
    assert docs == {"d.docx": ("one\ttwo\nhead", None), "e.docx": (None, "BadZipFile")}


def test_pages_and_judgments(spark, tmp_path):
    d = spark.createDataFrame([(1, 2, " b "), (1, 1, "a"), (1, 3, "  "), (2, 1, None)], "doc long, page long, text string")
    assert {r.doc: r.text for r in files.assembled_pages(d).collect()} == {1: "a\n\nb", 2: ""}
    assert {r.doc: r.error for r in files.assembled_pages(d, most_pages=2).collect()} == {1: "pages", 2: None}
    rows = [{"family": f"f{i // 4}", "path": "p", "query": f"q{i}", "intent": "x", "start_line": 1, "end_line": 2, "relevance_grade": 3} for i in range(32)]
    (tmp_path / "j.json").write_text(json.dumps(rows))
    j = files.judgments(spark, str(tmp_path / "j.json"))
    assert files.judgment_problems(j).count() == 0 and files.judgment_problems(j.limit(31)).count() > 0


def test_search_scopes_and_hits(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"s{i % 3}", "f", i, ["a/x.py", "b/y.md"][i % 2], ["python", "markdown"][i % 2], ["red fox", "blue whale", "red whale"][i % 3]) for i in range(12)], "chunk_id string, source_id string, file_id string, ordinal int, relative_path string, language string, content string")
    vectors = spark.createDataFrame([(f"c{i}", [1.0, 0.0] if i % 2 else [0.0, 1.0], "p") for i in range(12)], "chunk_id string, vector array<float>, embedding_profile_id string")
    visible = spark.createDataFrame([("s0",), ("s1",)], "source_id string")
    rows = [("all", "red", None, 12, 0.65, "Hybrid", None, None), ("none", "red", [], 12, 0.65, "Hybrid", None, None), ("bad", "red", ["s2"], 12, 0.65, "Hybrid", None, None), ("py", "red", ["s0", "s0"], 1, 0.65, "Lexical", "PYTHON", "A/"), ("blank", "", None, 12, 0.65, "Hybrid", None, None)]
    requests = spark.createDataFrame(rows, "query_id string, query string, source_ids array<string>, limit int, alpha double, mode string, language string, path_prefix string")
    q = spark.createDataFrame([(r[0], [1.0, 0.0], "p") for r in rows], "query_id string, vector array<float>, embedding_profile_id string")
    hits = search.search(requests, chunks, vectors, q, visible).collect()
    assert {h.query_id for h in hits} == {"all", "py"} and {h.source_id for h in hits} == {"s0", "s1"}
    py = [h for h in hits if h.query_id == "py"]
    assert len(py) == 1 and py[0].language == "python" and py[0].source_id == "s0"
    ranks = [h.rank for h in hits if h.query_id == "all"]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))
    other = vectors.withColumn("embedding_profile_id", F.lit("other"))
    assert search.vector(q.withColumnRenamed("query_id", "query_id"), other).count() == 0


def test_metrics(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "x", 1)], "query_id string, chunk_id string, rank int")
    rel = spark.createDataFrame([("q", "b", 3), ("r", "y", 3)], "query_id string, chunk_id string, grade int")
    got = {r.query_id: (r.recall, r.reciprocal_rank, round(r.ndcg, 4)) for r in evaluate.query_metrics(hits, rel, rel.select("query_id").union(spark.createDataFrame([("s",)], "query_id string"))).collect()}
    assert got == {"q": (1.0, 0.5, 0.6309), "r": (0.0, 0.0, 0.0), "s": (0.0, 0.0, 0.0)}
    t = spark.createDataFrame([(str(i), i, 2) for i in range(1, 41)], "file string, ms long, chunks int")
    assert one(evaluate.throughput(t)).p95_ms == 38


def test_embedding_job(spark):
    d = spark.createDataFrame([("h1", "red fox"), ("h1", "red fox"), ("h2", "")], "content_hash string, content string")
    v = embedded(d, lambda: hashing_encoder(32))
    good, bad = accepted(v, 32)
    assert one(good).content_hash == "h1" and one(bad).problem == "norm"
    s = spark.createDataFrame([("s", "other")], "source_id string, embedding_profile_id string")
    same, others = compatible(v.withColumn("source_id", F.lit("s")), s)
    assert same.count() == 0 and others.count() == 2


def test_wordpiece(spark):
    v = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "hello", "world", "##s", "!"])}
    d = spark.createDataFrame([(1, "Hello worlds!"), (2, None), (3, "zebra é")], "id long, text string")
    got = {r.id: (r.ids, r.n_tokens) for r in wordpiece(d, v).collect()}
    assert got == {1: ([2, 4, 5, 6, 7, 3], 6), 2: ([2, 3], 2), 3: ([2, 1, 1, 3], 4)}
    assert wordpiece(d, v, most=5).filter("over").count() == 1


def test_coalescing_state():
    r = hints.Recovery()
    for i in range(64):
        r = hints.advanced(r, "request", 1 << i % 7)
    assert (r.desired, r.pending_mask, r.state) == (1, 127, "Queued")
    r = hints.advanced(r, "start", 0)
    for _ in range(5):
        r = hints.advanced(r, "request", 2)
    assert (r.desired, r.active, r.pending_mask) == (2, 1, 2)
    r = hints.advanced(r, "transient", 0, 1)
    assert (r.state, r.attempt, r.pending_mask) == ("Queued", 1, 255)
    r = hints.advanced(r, "start", 0)
    assert hints.advanced(r, "complete", 0, 7) == r  # an outcome of another generation
    r = hints.advanced(r, "complete", 0, 1)
    assert (r.completed, r.state) == (1, "Queued")
    r = hints.advanced(hints.advanced(r, "start", 0), "fail", 0, 2)
    assert r.state == "Degraded" and hints.advanced(r, "request", 64).state == "Queued"


def test_manual_requests_expedite_a_waiting_retry():
    r = hints.advanced(hints.advanced(hints.Recovery(), "request", 2), "start", 0)
    r = hints.advanced(r, "transient", 0, 1, at=100, base_seconds=30)
    assert (r.state, r.due) == ("Queued", 130) and hints.advanced(r, "start", 0, at=120) == r
    assert hints.advanced(r, "start", 0, at=130).state == "Running"
    assert hints.advanced(hints.advanced(r, "request", 2, at=110), "start", 0, at=120).state == "Queued"
    assert hints.advanced(hints.advanced(r, "request", 64, at=110), "start", 0, at=110).state == "Running"
    again = hints.advanced(hints.advanced(r, "start", 0, at=130), "transient", 0, 1, at=140, base_seconds=30)
    assert again.due == 200 and again.attempt == 2


def test_changes_are_indexed(spark, tmp_path):
    """A hint leads to a pass over its source; the files of other sources stay."""
    (tmp_path / "in").mkdir()
    rows = [("a", "x.md", 5, 1, "# A"), ("b", "y.txt", 4, 1, "text")]
    corpus = spark.createDataFrame(rows, "source_id string, relative_path string, size_bytes long, modified long, text string")
    base = str(tmp_path / "base")
    index_pass(spark, corpus, base)
    now = spark.createDataFrame([("a", "x.md", 6, 2, "# AB"), ("a", "z.md", 3, 1, "# C")], corpus.schema)
    lines = [{"source_id": "a", "ts": "2024-01-01T00:00:00Z", "kind": "changed"}, {"source_id": "q", "ts": "2024-01-01T01:00:00Z", "kind": "changed"}]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "in/2.json").write_text(json.dumps({"source_id": "q", "ts": "2024-01-01T03:00:00Z", "kind": "changed"}))
    passes = hints.indexing(spark, lambda due: now.join(due, "source_id", "left_semi"), base)
    hints.index_changes(hints.hints(spark, str(tmp_path / "in")), passes, str(tmp_path / "cp")).awaitTermination(240)
    got = {(r.source_id, r.relative_path): r.content for r in versions.read(spark, f"{base}/chunks").collect()}
    assert got == {("a", "x.md"): "# AB", ("a", "z.md"): "# C", ("b", "y.txt"): "text"}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"source_id": s, "ts": f"2024-01-01T00:00:{t:06.3f}Z", "kind": k} for s, t, k in (("a", 0, "changed"), ("a", 6, "overflow"), ("a", 20, "error"), ("b", 1, "created"))]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, lines)))
    batch = hints.debounced(spark.read.schema(hints.CHANGE_HINTS).json(str(tmp_path / "in"))).collect()
    assert {(r.source_id, r.cause_mask, r.hints) for r in batch} == {("a", 6, 2), ("a", 8, 1), ("b", 2, 1)}
    (tmp_path / "in/2.json").write_text(json.dumps({"source_id": "z", "ts": "2024-01-01T01:00:00Z", "kind": "changed"}))
    due = []
    hints.index_changes(hints.hints(spark, str(tmp_path / "in")), lambda d, i: due.extend(r.source_id for r in d.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert set(due) >= {"a", "b"}
    (tmp_path / "ev").mkdir()
    events = [("a", 1, "request", 2, 0), ("a", 2, "start", 0, 0), ("a", 3, "request", 4, 0), ("a", 4, "complete", 0, 1), ("b", 1, "request", 1, 0)]
    spark.createDataFrame(events, "source_id string, seq long, event string, mask int, generation long").write.mode("append").parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("source_id string, seq long, event string, mask int, generation long").parquet(str(tmp_path / "ev"))
    q = hints.coalesced_stream(stream).writeStream.format("memory").queryName("ledger").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    assert {(r.source_id, r.desired, r.completed, r.state) for r in spark.table("ledger").collect()} == {("a", 2, 1, "Queued"), ("b", 1, 0, "Queued")}


def test_timers_need_no_event(spark, tmp_path):
    """A waiting retry starts, and a run past its lease is scheduled and started again, while no event comes."""
    columns = "source_id string, seq long, event string, mask int, generation long"
    events = [("a", 1, "request", 2, 0), ("a", 2, "start", 0, 0), ("a", 3, "transient", 0, 1), ("b", 1, "request", 1, 0), ("b", 2, "start", 0, 0), ("c", 1, "request", 1, 0), ("c", 2, "start", 0, 0), ("c", 3, "complete", 0, 1)]
    spark.createDataFrame(events, columns).coalesce(1).write.parquet(str(tmp_path / "ev"))
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    timers.with_timers(spark)
    try:
        stream = timers.timed_generations(spark.readStream.schema(columns).parquet(str(tmp_path / "ev")), base_seconds=2, lease_seconds=4)
        q = stream.writeStream.format("memory").queryName("timed").outputMode("update").trigger(processingTime="500 milliseconds").option("checkpointLocation", str(tmp_path / "cp")).start()
        rows, end = [], time.time() + 120
        while time.time() < end and not ({("a", "retry"), ("b", "lease"), ("b", "retry")} <= {(r.source_id, r.why) for r in rows}):
            time.sleep(0.5)
            assert q.exception() is None
            rows = spark.table("timed").collect()
        q.stop()
    finally:
        if provider:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    first = {(r.source_id, r.why): r for r in sorted(rows, key=lambda r: -r.at_ms)}
    assert first["a", "events"].state == "Queued" and first["a", "events"].attempt == 1
    assert first["a", "retry"].state == "Running" and first["a", "retry"].at_ms >= first["a", "events"].due * 1000
    assert first["b", "events"].state == "Running" and first["b", "lease"].state == "Queued" and first["b", "lease"].pending_mask & 128
    assert first["b", "lease"].at_ms >= first["b", "events"].lease_ends * 1000 and first["b", "retry"].state == "Running"
    assert first["c", "events"].state == "Clean" and ("c", "retry") not in first


def test_order_statistic(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "CELLS", 7)
    monkeypatch.setattr(evaluate, "SORTED", 5)
    r = random.Random(3)
    for values in ([r.gauss(0, 1000) for _ in range(300)], [float(r.randrange(9)) for _ in range(300)], [3.0] * 50, [1e300, -1e300, 0.0, 5.0, 5.0, 7.0, 8.0], [2.0], [None, 4.0, None], []):
        d = spark.createDataFrame([(v,) for v in values], "v double")
        real = sorted(v for v in values if v is not None)
        for share in (0.95, 0.5, 0.01):
            want = real[max(1, math.ceil(share * len(real) - 1e-9)) - 1] if real else None
            assert evaluate.nearest_rank(d, "v", share) == want


def test_relevance_by_bins(spark):
    r = random.Random(5)
    chunks = [(f"c{i}", "long.py", a, a + r.choice([0, 3, 70, 400])) for i, a in enumerate(r.randrange(1, 900) for _ in range(60))] + [("odd", "long.py", 9, 3), ("other", "b.py", 1, 999)]
    judged = [(f"q{i % 9}", "long.py", a, a + r.choice([0, 10, 200]), 1 + i % 3) for i, a in enumerate(r.randrange(1, 900) for _ in range(40))]
    want = {}
    for q, path, a, z, g in judged:
        for c, where, s, e in chunks:
            if where == path and e >= s and e >= a and s <= z:
                want[q, c] = max(g, want.get((q, c), 0))
    got = evaluate.relevant(spark.createDataFrame(chunks, "chunk_id string, relative_path string, start_line int, end_line int"), spark.createDataFrame(judged, "query_id string, path string, start_line int, end_line int, relevance_grade int"))
    assert {(x.query_id, x.chunk_id): x.grade for x in got.collect()} == want and got.count() == len(want)


def test_ledger_rules(spark):
    runs = spark.createDataFrame([(f"j{i}", "s", i, st, i) for i, st in enumerate(["Completed", "Failed", "Completed", "Completed", "Completed"], 1)], "job_id string, source_id string, generation long, status string, completed long")
    assert {r.job_id for r in ledger.prunable(runs, 2).collect()} == {"j1", "j2", "j3"}
    last = runs.withColumn("status", F.when(F.col("job_id") == "j5", "Failed").otherwise("Failed"))
    assert ledger.prunable(last, 2).count() == 0
    f = spark.createDataFrame([("a", 0, "FileUnstable", 2), ("b", 4, "FileUnstable", 2), ("c", 0, "SourceMissing", 2)], "job_id string, attempt int, code string, cause_mask int")
    got = {r.job_id: (r.status, r.attempt, r.cause_mask, r.delay_s, r.dead_letter) for r in ledger.after_failure(f, 5, 10).collect()}
    assert got == {"a": ("RetryScheduled", 1, 130, 10, False), "b": ("Failed", 4, 2, 0, True), "c": ("Failed", 0, 2, 0, True)}
    s = spark.createDataFrame([("Degraded", states.SUMMARIES["SourceMissing"], 0, True), ("Degraded", states.SUMMARIES["SourceMissing"], 3000, False), ("Degraded", "other", 0, False)], "status string, e string, since long, want boolean")
    assert all(r[0] == r[1] for r in s.select("want", states.missing_root_expired(F.col("status"), F.col("e"), F.col("since"), F.lit(3600))).collect())


def test_entry_points(spark, sf):
    import __spark_entry__ as e

    assert set(queries.ORACLES) <= set(queries.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
