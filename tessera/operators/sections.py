"""Section chunking as DataFrame operations: Markdown headings, JSON properties, YAML keys, TOML tables.

Input: files with file_id, relative_path and content (newlines normalised).
Units: file_id, kind, symbol, qualified, locator, start_line, end_line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import extension, lines

# What heads a section, and how its units are named.
HEADING = r"(?U)^#{1,6}\s+(.+?)\s*#*\s*$"
PROPERTY = r"""^  "((?:[^"\\]|\\.)+)"\s*:"""
KEY = r"^([^\s#][^:#]*):(?:\s|$)"
TABLE = r"^\s*\[\[?([^\]]+)\]\]?\s*(?:#.*)?$"
FAMILIES = {"markdown": ([".md"], HEADING, "section"), "json": ([".json"], PROPERTY, "property"), "yaml": ([".yaml", ".yml"], KEY, "key"), "toml": ([".toml"], TABLE, "table")}
BLANK = r"(?U)^\s*$"
#: What says nothing about brackets: closed quotes, in which a backslash shields what follows, what stands behind a # outside quotes, and all other characters.
PLAIN = r"""(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|#.*|[^\[\]{}'"#]++"""


def family(path: Column) -> Column:
    ext = extension(path)
    return reduce(lambda out, f: F.when(ext.isin(FAMILIES[f][0]), f).otherwise(out), FAMILIES, F.lit(None).cast("string"))


def _per_family(index: int) -> Column:
    return reduce(lambda out, f: F.when(F.col("family") == f, FAMILIES[f][index]).otherwise(out), FAMILIES, F.lit(None).cast("string"))


def balanced(value: Column) -> Column:
    """Whether quotes close and brackets pair up before any # outside quotes; a backslash inside quotes shields what follows."""
    left = F.regexp_replace(value, PLAIN, "")  # brackets in their order, and quotes that don't close
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("bad"))

    def step(s: Column, c: Column) -> Column:
        top, closes = F.substring(s["open"], -1, 1), c.isin("]", "}")
        fits = ((c == "]") & (top == "[")) | ((c == "}") & (top == "{"))
        stack = F.when(c.isin("[", "{"), F.concat(s["open"], c)).when(closes & fits, F.substring(s["open"], F.lit(1), F.greatest(F.lit(0), F.length(s["open"]) - 1))).otherwise(s["open"])
        return F.struct(stack.alias("open"), (s["bad"] | (closes & ~fits)).alias("bad"))

    nested = F.aggregate(F.split(left, ""), start, step, lambda s: ~s["bad"] & (s["open"] == ""))
    return F.when(~value.rlike("['\"\\[\\]{}]"), True).when(left == "", True).when(left.rlike("['\"]"), False).otherwise(nested)


def malformed(files: DataFrame) -> Column:
    """Whether a file of a section family can't be cut into sections (JSON that doesn't parse, YAML and TOML outside their line forms)."""
    every = lines(F.col("content"))

    def value_ok(trimmed: Column, separator: str) -> Column:
        at = F.instr(trimmed, separator)
        return (at == 0) | balanced(F.substring(trimmed, at + 1, F.length(trimmed)))

    def yaml_bad(line: Column) -> Column:
        t = F.trim(line)
        skip = (t == "") | t.startswith("#") | t.isin("---", "...")
        form = F.when(F.length(line) == F.length(t), line.rlike(KEY)).otherwise(t.startswith("- ") | F.contains(t, F.lit(":")))
        return line.startswith("\t") | (~skip & ~(form & value_ok(t, ":")))

    def toml_bad(line: Column) -> Column:
        t = F.trim(line)
        skip = (t == "") | t.startswith("#")
        form = F.when(t.startswith("["), line.rlike(TABLE)).otherwise(F.contains(t, F.lit("=")))
        return ~skip & ~(form & value_ok(t, "="))

    kind = family(F.col("relative_path"))
    return F.when(kind == "json", F.try_parse_json("content").isNull()).when(kind == "yaml", F.exists(every, yaml_bad)).when(kind == "toml", F.exists(every, toml_bad)).otherwise(F.lit(False))


def sections(files: DataFrame) -> DataFrame:
    """Units of the files of the four families, heads first found by pattern; malformed files must be left out before.

    Every text is read once: it gives a row for each head, and one at line 0 that stands for the file.
    """
    def full(line: Column) -> Column:
        return ~line.rlike(BLANK) & ~(F.col("family").isin("yaml", "toml") & F.ltrim(line).startswith("#"))

    f = files.select("file_id", family(F.col("relative_path")).alias("family"), lines(F.col("content")).alias("l")).filter(F.col("family").isNotNull())
    f = f.select("file_id", "family", F.size("l").alias("total"), F.array_position(F.transform("l", full), True).cast("int").alias("first"), "l")
    rows = f.select("file_id", "family", "total", "first", F.posexplode(F.concat(F.array(F.lit("")), "l")).alias("at", "line"))
    name = reduce(lambda out, k: F.when(F.col("family") == k, F.regexp_extract("line", FAMILIES[k][1], 1)).otherwise(out), FAMILIES, F.lit(""))
    heads = rows.withColumn("name", F.trim(name)).filter((F.col("name") != "") | (F.col("at") == 0))
    level = F.when(F.col("family") == "markdown", F.length(F.regexp_extract("line", "^(#*)", 1))).otherwise(1)
    heads = heads.withColumn("level", F.when(F.col("at") > 0, level)).drop("line")
    by_line = Window.partitionBy("file_id").orderBy("at")
    heads = heads.withColumn("next", F.lead("at").over(by_line))
    # ancestors: the last heading of each shallower level, unless one as shallow or shallower came after it
    before = by_line.rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") == k, F.struct("at", "name")), ignorenulls=True).over(before) for k in range(1, 6)}
    heads = heads.withColumns({f"_{k}": c for k, c in last.items()})
    path = []
    for k in range(1, 6):
        shadow = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"_{j}")["at"] > F.col(f"_{k}")["at"], F.lit(False)) for j in range(1, k)), F.lit(False))
        path.append(F.when((F.col("level") > k) & ~shadow, F.col(f"_{k}")["name"]))
    head, markdown, kind = F.col("at") > 0, F.col("family") == "markdown", _per_family(2)
    # what stands before the first heading, where it isn't blank, and whole files without a head
    lead_in, whole = ~head & markdown & (F.col("first") > 0) & (F.col("first") < F.col("next")), ~head & (F.col("first") > 0) & F.col("next").isNull()
    units = heads.withColumn("qualified", F.when(head, F.concat_ws(" / ", *path, F.col("name")))).filter(head | lead_in | whole)
    units = units.withColumn("start_line", F.greatest("at", F.lit(1))).withColumn("end_line", F.coalesce(F.col("next") - 1, F.col("total")))
    label = F.when(head, F.concat(F.when(markdown, "heading").otherwise(kind), F.lit(":"), F.col("qualified"), F.lit("@"))).when(whole, F.concat(F.when(markdown, "section").otherwise(F.col("family")), F.lit(":"))).otherwise("preamble:")
    locator = F.concat(label, F.lit("lines:"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    bare = F.when(whole & (F.col("family") == "json"), "object").otherwise(kind)
    return units.select("file_id", bare.alias("kind"), F.when(head, F.col("name")).alias("symbol"), "qualified", locator.alias("locator"), "start_line", "end_line")


def gaps(files: DataFrame, units: DataFrame) -> DataFrame:
    """Runs of lines that no unit covers, from their first line that isn't blank, as text units."""
    f = files.select("file_id", "relative_path", lines(F.col("content")).alias("l"))
    covered = units.select("file_id", F.explode(F.sequence("start_line", "end_line")).alias("at")).distinct()
    rows = f.select("file_id", "relative_path", F.posexplode("l").alias("p", "line")).withColumn("at", F.col("p") + 1).join(covered, ["file_id", "at"], "left_anti")
    by_line = Window.partitionBy("file_id").orderBy("at")
    island = rows.withColumn("island", F.col("at") - F.row_number().over(by_line)).withColumn("full", ~F.col("line").rlike(BLANK))
    runs = island.groupBy("file_id", "relative_path", "island").agg(F.min(F.when(F.col("full"), F.col("at"))).alias("start_line"), F.max("at").alias("end_line")).filter(F.col("start_line").isNotNull())
    prefix = F.coalesce(family(F.col("relative_path")), F.lit("text"))
    locator = F.concat(prefix, F.lit(":gap:lines:"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return runs.select("file_id", F.lit("text").alias("kind"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("qualified"), locator.alias("locator"), "start_line", "end_line")


def ordered(units: DataFrame) -> DataFrame:
    order = Window.partitionBy("file_id").orderBy("start_line", "end_line", "locator")
    return units.withColumn("ordinal", F.row_number().over(order) - 1)


def invalid_files(files: DataFrame, units: DataFrame) -> DataFrame:
    """file_id of files whose units leave the file, lack a kind or locator, or share a locator."""
    total = files.select("file_id", F.size(lines(F.col("content"))).alias("total"))
    bad = (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")) | (F.col("end_line") > F.col("total")) | (F.trim(F.coalesce("kind", F.lit(""))) == "") | (F.trim(F.coalesce("locator", F.lit(""))) == "")
    checked = units.join(total, "file_id").groupBy("file_id").agg(F.max(F.coalesce(bad, F.lit(True))).alias("bad"), F.count(F.lit(1)).alias("n"), F.countDistinct("locator").alias("d"))
    return checked.filter(F.col("bad") | (F.col("n") != F.col("d"))).select("file_id")


def chunk_violations(chunks: DataFrame, most_tokens: int) -> DataFrame:
    """file_id, rule: what stored chunks must meet, row by row and within a file.  Rules of columns that ``chunks`` doesn't have are left out."""
    needed = ["chunk_id", "source_id", "file_id", "relative_path", "language", "content", "content_hash", "chunk_kind", "structural_locator", "chunker_id", "chunker_version"]
    rules = {f"missing {c}": F.trim(F.coalesce(F.col(c), F.lit(""))) == "" for c in needed if c in chunks.columns}
    if {"start_line", "end_line"} <= set(chunks.columns):
        rules["lines"] = (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line"))
    rules["tokens"] = ~F.col("token_count").between(1, most_tokens)
    rows = chunks.select("file_id", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(True)), n) for n, t in rules.items())))).alias("rule"))
    single = {name: c for name, c in {"repeated id": "chunk_id", "repeated locator": "structural_locator"}.items() if c in chunks.columns}
    per = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ordinal").alias("ordinals"), F.max("ordinal").alias("top"), F.min("ordinal").alias("low"), *(F.countDistinct(c).alias(f"n_{c}") for c in single.values()))
    tests = {name: F.col(f"n_{c}") != F.col("n") for name, c in single.items()}
    tests["ordinals"] = (F.col("ordinals") != F.col("n")) | (F.col("top") + 1 != F.col("n")) | (F.col("low") != 0)
    files = per.select("file_id", F.explode(F.array_compact(F.array(*(F.when(t, n) for n, t in tests.items())))).alias("rule"))
    return rows.unionByName(files).distinct()


def chunking_metrics(chunks: DataFrame, timings: DataFrame | None = None) -> DataFrame:
    """Files, chunks and fallbacks by chunker, version and outcome, with total and longest time where ``timings`` (file_id, ms) are given.

    chunks: file_id, chunker_id, chunker_version, outcome.
    """
    by = ["chunker_id", "chunker_version", "outcome"]
    files = chunks.groupBy("file_id", *by).agg(F.count(F.lit(1)).alias("n"))
    timed = [] if timings is None else [F.sum("ms").alias("total_ms"), F.max("ms").alias("longest_ms")]
    files = files if timings is None else files.join(timings.groupBy("file_id").agg(F.max("ms").alias("ms")), "file_id", "left")
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("chunks"), F.count_if(F.col("outcome") != "structural").alias("fallbacks"), *timed)
