"""Secret scans.

One pass of an Aho-Corasick automaton over the text finds keywords; a
regular expression is tried only where a keyword begins, anchored there.
Hexadecimal runs have no keyword: a byte-class test that probes every twelfth
byte and looks around only where the probe is hexadecimal takes its place.
Tokens that carry a checksum are checked: the six last
characters of ``gh[pousr]_`` and ``npm_`` tokens are the CRC-32 of what
stands before them in base 62.

Spans are (kind, start, end) in code points, end exclusive.  Kinds, in the
order in which ties of a start are listed: assign, access, hex, github, npm.

Edge cases: a null text is empty; a text without a secret has no span; a
match that fails its length test is dropped but still uses up its text, as
in a left-to-right scan; repeated rows each get a row.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

# The patterns of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEYWORDS = {"assign": ["password", "passwd", "secret", "token", "apikey", "api_key"], "access": ["akia"], "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], "npm": ["npm_"]}
KINDS = ["assign", "access", "hex", "github", "npm"]
BASE_KINDS = KINDS[:3]
LEAST_HEX, LEAST_ACCESS, LEAST_VALUE = 24, 20, 6
_LOWER = {i: i + 32 for i in range(65, 91)}
_PROBE = LEAST_HEX // 2


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def _hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """Maximal hexadecimal runs of LEAST_HEX or more: each holds two neighbouring probes, so two in a row are looked for."""
    probes = text[::_PROBE]
    for m in re.finditer(r"[0-9a-f]{2,}", probes):
        lo, hi = m.start() * _PROBE, (m.end() - 1) * _PROBE
        start = lo
        while start > 0 and start > lo - _PROBE and text[start - 1] in "0123456789abcdef":
            start -= 1
        # runs between the first and the last probe, and up to one stride beyond each
        for run in HEX.finditer(text, start):
            if run.start() > hi:
                break
            if run.end() - run.start() >= LEAST_HEX:
                yield run.span()


def find_secrets(text: str, words: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start, then kind as listed."""
    found: list[tuple[int, int, int]] = []
    free = dict.fromkeys(KEYWORDS, 0)  # where each kind's scan stands
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    for end, (kind, size) in words.iter(low):
        at = end - size + 1
        if at < free[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                free[kind] = m.end()
                if m.end(2) - m.start(2) >= LEAST_VALUE:
                    found.append((at, 0, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                free[kind] = m.end()
                if m.end() - at >= LEAST_ACCESS:
                    found.append((at, 1, m.end()))
        elif m := (GITHUB if kind == "github" else NPM).match(text, at):
            free[kind] = m.end()
            if base62_crc(m[1]) == m[2]:
                found.append((at, KINDS.index(kind), m.end()))
    seen = -1
    for start, end in _hex_runs(text):
        if start > seen:
            found.append((start, 2, end))
            seen = start
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Every row of docs with n_assign, n_access, n_hex, base_sha256 and spans."""
    new = {"n_assign": LongType(), "n_access": LongType(), "n_hex": LongType(), "base_sha256": StringType(), "spans": StringType()}
    docs = docs.drop(*new)
    schema = StructType([*docs.schema.fields, *(StructField(k, v) for k, v in new.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                spans = find_secrets(text.as_py() or "", words)
                base = [s for s in spans if s[0] in BASE_KINDS]
                n = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.record_batch([*batch.columns, *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=[*batch.schema.names, *new])

    return docs.mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """docs with every span of ``text`` replaced by ``mask`` (overlapping spans once); n_chars, where there is one, follows."""
    size = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            texts, lens = [], []
            for value in batch.column("text"):
                text = value.as_py()
                spans = find_secrets(text, words) if text else []
                out, at = [], 0
                for _, s, e in spans:
                    if e <= at:
                        continue
                    if s >= at:
                        out += [text[at:s], mask]
                    at = e
                texts.append("".join([*out, text[at:]]) if spans else text)
                lens.append(bool(spans))
            cols = dict(zip(batch.schema.names, batch.columns))
            cols["text"] = pa.array(texts, batch.schema.field("text").type)
            if size:
                old = cols["n_chars"].to_pylist()
                cols["n_chars"] = pa.array([len(t) if hit else n for t, hit, n in zip(texts, lens, old)], batch.schema.field("n_chars").type)
            yield pa.record_batch(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, docs.schema)
