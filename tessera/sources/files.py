"""File scans and text sources."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import TEXT_EXTENSIONS, extension, is_eligible, normalise_newlines
from ..schemas import JUDGMENTS


def scan(spark: SparkSession, root: str, source_id: str) -> DataFrame:
    """Eligible files under a folder, without their content unless it is selected.

    Files that can't be read fail the scan rather than look deleted.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", False).option("ignoreCorruptFiles", False).load(root)
    # the listing names files with a scheme in front; what follows the root is the relative path
    base = re.sub(r"^file:/*|/+$", "", root).lstrip("/")
    path = F.element_at(F.split(F.col("path"), re.escape(f"{base}/"), 2), -1)
    out = raw.select(F.lit(source_id).alias("source_id"), path.alias("relative_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")
    return out.filter(is_eligible(F.col("relative_path"), F.col("size_bytes")))


def plain_texts(files: DataFrame) -> DataFrame:
    """source_id, relative_path, text of files that aren't documents: UTF-8, mark off, newlines normalised."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return files.filter(~extension(F.col("relative_path")).isin(".docx", ".pdf")).select("source_id", "relative_path", normalise_newlines(text).alias("text"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Most bytes that a document's parts may unpack to.
MOST_UNPACKED = 50 << 20
# The parts of a word-processing document, in reading order.
PARTS = ["document", "header", "footer", "footnotes", "endnotes", "comments"]


def docx_text(data: bytes, most: int = MOST_UNPACKED) -> str:
    """Paragraphs of all parts; deleted revisions are left out."""
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [i for p in PARTS for i in sorted((i for i in z.infolist() if i.filename.startswith(f"word/{p}") and i.filename.endswith(".xml") and "/" not in i.filename[5:]), key=lambda i: i.filename)]
        if sum(i.file_size for i in names) > most:
            raise ValueError("the document unpacks to more than is allowed")
        for i in names:
            xml = z.read(i)
            if b"<!DOCTYPE" in xml:
                raise ValueError("document types are not read")
            for paragraph in ElementTree.fromstring(xml).iter(f"{_W}p"):
                out.append("".join(_runs(paragraph)))
    return "\n".join(out)


def _runs(node) -> Iterator[str]:
    # Elements that stand for characters.
    marks = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "‑", "softHyphen": "­"}
    for child in node:
        name = child.tag.removeprefix(_W)
        if name in ("del", "moveFrom", "p"):
            continue
        if name == "t":
            yield child.text or ""
        elif name in marks:
            yield marks[name]
        else:
            yield from _runs(child)


#: kind of file: (extensions, function from bytes to text).  Every extension belongs to one kind.
EXTRACTORS: dict[str, tuple[list[str], Callable[[bytes], str]]] = {
    "plain": ([*TEXT_EXTENSIONS, ""], lambda data: data.decode("utf-8-sig", "replace")),
    "word": ([".docx"], docx_text),
}


def extracted(files: DataFrame, extractors: dict[str, tuple[list[str], Callable[[bytes], str]]] | None = None) -> DataFrame:
    """source_id, relative_path, text, error of scanned files; newlines normalised.

    A file that no extractor takes or that breaks its own gives an error, not a failed task; two extractors of one extension are refused.
    """
    known = EXTRACTORS if extractors is None else extractors
    owner: dict[str, Callable[[bytes], str]] = {}
    for ends, extract in known.values():
        for end in ends:
            if end in owner:
                raise ValueError(f"two extractors take {end or 'files without extension'}")
            owner[end] = extract

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for end, data in zip(batch.column("ext").to_pylist(), batch.column("content").to_pylist()):
                try:
                    texts.append(owner[end](data or b""))
                    errors.append(None)
                except Exception as e:  # an extractor may fail on a file in any way
                    texts.append(None)
                    errors.append("Unsupported" if end not in owner else type(e).__name__)
            yield pa.record_batch({"source_id": batch.column("source_id"), "relative_path": batch.column("relative_path"), "text": pa.array(texts, pa.string()), "error": pa.array(errors, pa.string())})

    out = files.select("source_id", "relative_path", extension(F.col("relative_path")).alias("ext"), "content").mapInArrow(run, "source_id string, relative_path string, text string, error string")
    return out.withColumn("text", normalise_newlines(F.col("text")))


def docx_texts(files: DataFrame) -> DataFrame:
    """source_id, relative_path, text, error of .docx files."""
    return extracted(files.filter(extension(F.col("relative_path")) == ".docx"), {"word": EXTRACTORS["word"]})


def assembled_pages(pages: DataFrame, most_pages: int = 1_000, most_chars: int = 10_000_000) -> DataFrame:
    """doc, text, pages, chars, error: the trimmed pages that aren't blank, in order, a blank line between; caps give an error and no text.

    pages: doc, page, text.
    """
    trimmed = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    rows = pages.select("doc", "page", trimmed.alias("t"))
    sizes = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("t")).alias("chars"))
    error = F.when(F.col("pages") > most_pages, "pages").when(F.col("chars") > most_chars, "characters")
    # only documents within the caps are gathered
    per = rows.join(sizes.filter(error.isNull()).select("doc"), "doc", "left_semi").groupBy("doc").agg(F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("page", "t")))).alias("p"))
    return sizes.join(per, "doc", "left").select("doc", F.array_join(F.col("p.t"), "\n\n").alias("text"), "pages", "chars", error.alias("error"))


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """Judged queries from a JSON array, with a query_id by content."""
    raw = spark.read.schema(JUDGMENTS).json(path, multiLine=True)
    return raw.withColumn("query_id", F.sha2(F.concat_ws("\n", "family", "path", "query").cast("binary"), 256))


def judgment_problems(j: DataFrame, rows: int = 32, families: int = 8) -> DataFrame:
    """problem: what is wrong with the shape of a set of judgments; no row if nothing."""
    per = j.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    shape = j.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("family").alias("f"), F.min("relevance_grade").alias("low"), F.max("relevance_grade").alias("high"))
    tests = {"rows": F.col("n") != rows, "families": F.col("f") != families, "grades": (F.col("low") < 1) | (F.col("high") > 3)}
    return shape.select(F.explode(F.array_compact(F.array(*(F.when(t, n) for n, t in tests.items())))).alias("problem")).unionByName(per.filter(F.col("n") != rows // families).select(F.concat(F.lit("family "), "family").alias("problem")))
