"""Token counts of whole texts, as a tokenizer's own library gives them.

A text is cut where no piece of the vocabulary spans, so that the tokens of
the parts are the tokens of the whole: before a run of spaces and around line
ends.  The token counts of the parts (pre-tokens) are looked up on the map
side in two tiers: a compact hash table of the most frequent pre-tokens,
which is broadcast, then a cache in each worker, which the misses are encoded
into.  No pre-token is shuffled, and counting is one pass without an exchange.

The table is filled from a sample of SAMPLE_DOCS documents, picked by hash; a
task sends at most SAMPLE_KEYS pre-tokens of what it sampled.  It decides how fast
counts are found, never what they are.

Which cuts are safe is read off the vocabulary itself (``Pieces``).  A vocabulary with none, or a normalizer that
changes texts, is used on whole texts instead.  Pre-tokens of more than
LONG_KEY characters, such as texts in scripts without blanks, are cut further wherever no piece
holds the two characters that meet; a longer run in which pieces span every pair is encoded in one go.

Edge cases: a null text counts as empty and has no token; rows with a null or
repeated doc_id each have a row of the result; further columns don't matter; an empty
table gives no row; long texts are read in stretches of STRETCH characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Shared

#: Documents whose pre-tokens fill the table, pre-tokens sent by a task, entries of the table, and characters of an entry.
SAMPLE_DOCS, SAMPLE_KEYS, TABLE_KEYS, KEY_CHARS = 2_000, 2_000, 65_536, 64
#: Entries of a worker's cache.
CACHE_KEYS = 200_000
#: Characters from which on a pre-token is cut between pairs, and characters of a text that are split at once.
LONG_KEY, STRETCH = 256, 1 << 20


class Pieces:
    """A sentencepiece model, loaded from its bytes where it is used."""

    def __init__(self, model: bytes):
        self.model, self._ready = model, None

    def __getstate__(self) -> dict:
        return {"model": self.model, "_ready": None}

    @property
    def ready(self):
        """(processor, whether cuts are safe, pairs of characters that pieces hold)."""
        if self._ready is None:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=self.model)
            own = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
            same = sp.normalize("ａ  ﬁ ") == "▁ａ▁▁ﬁ▁" and sp.is_byte(sp.piece_to_id("<0x0A>"))
            apart = not any("▁" in p.lstrip("▁") or "\n" in p for p in own)
            pairs = {ord(a) << 21 | ord(b) for p in own for a, b in zip(p, p[1:])}
            self._ready = sp, same and apart, np.array(sorted(pairs), np.int64)
        return self._ready

    @property
    def splits(self) -> bool:
        return self.ready[1]

    def whole(self, text: str) -> int:
        return len(self.ready[0].encode(text))

    _keys = re.compile("▁*[^▁\n]+|▁+|\n+")

    def keys(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, in order, by stretches; the library puts one space before a text."""
        text = "▁" + text.replace(" ", "▁") if text else ""
        at = 0
        while at < len(text):
            end = text.find("▁", at + STRETCH)
            while end > 0 and text[end - 1] == "▁":  # not inside a run of spaces
                end = text.find("▁", end + 1)
            end = end if end > 0 else len(text)
            yield self._keys.findall(text[at:end])
            at = end

    def encoded(self, parts: list[str]) -> list[int]:
        """Tokens of each part of a text: nothing joins a line end, so what follows one is encoded as inside a text."""
        encode = self.ready[0].encode
        ahead = len(encode("\n"))
        return [len(encode("\n" + p)) - ahead for p in parts]

    def length(self, key: str) -> int:
        if len(key) <= LONG_KEY:
            return self.encoded([key])[0]
        code = np.frombuffer(key.encode("utf-32-le"), np.uint32).astype(np.int64)
        cuts = [0, *(np.flatnonzero(~np.isin(code[:-1] << 21 | code[1:], self.ready[2])) + 1).tolist(), len(key)]
        parts = Counter(key[a:b] for a, b in zip(cuts, cuts[1:]))
        return sum(n * k for n, k in zip(self.encoded(list(parts)), parts.values()))


class Json:
    """A model of the tokenizers library, loaded from its JSON where it is used."""

    def __init__(self, model: bytes):
        self.model, self._ready = model, None

    def __getstate__(self) -> dict:
        return {"model": self.model, "_ready": None}

    @property
    def ready(self):
        if self._ready is None:
            import tokenizers

            t = tokenizers.Tokenizer.from_str(self.model.decode())
            t.no_padding()
            t.no_truncation()
            added = [a.content for a in t.get_added_tokens_decoder().values()]
            self._ready = t, added
        return self._ready

    @property
    def splits(self) -> bool:
        return self.ready[0].pre_tokenizer is not None

    def whole(self, text: str) -> int:
        return len(self.ready[0].encode(text, add_special_tokens=False).ids)

    def keys(self, text: str) -> Iterator[list[str]]:
        """The library's own pre-tokens; none for a text that holds an added token, which is encoded whole."""
        t, added = self.ready
        if any(a in text for a in added):
            yield [text]
            return
        clean = t.normalizer.normalize_str(text) if t.normalizer else text
        yield ["\0" + piece for piece, _ in t.pre_tokenizer.pre_tokenize_str(clean)]

    def length(self, key: str) -> int:
        return len(self.ready[0].model.tokenize(key[1:])) if key[0] == "\0" else self.whole(key)


class Lengths(dict):
    """Tokens by pre-token: the broadcast table, then this worker's cache, then the encoder."""

    def __init__(self, tokenizer: Pieces | Json, frequent: dict[str, int]):
        super().__init__(frequent)
        self.tokenizer, self.cache = tokenizer, {}

    def __missing__(self, key: str) -> int:
        n = self.cache.get(key)
        if n is None:
            n = self.tokenizer.length(key)
            if len(key) <= KEY_CHARS:
                if len(self.cache) >= CACHE_KEYS:
                    self.cache.clear()
                self.cache[key] = n
        return n

    def of(self, text: str) -> int:
        if not self.tokenizer.splits:
            return self.tokenizer.whole(text)
        return sum(sum(map(self.__getitem__, keys)) for keys in self.tokenizer.keys(text))


def load_tokenizer(path: str) -> Pieces | Json:
    """The tokenizer of a .model or .json file, which only the driver reads; its bytes go to the workers."""
    model = Path(path).read_bytes()
    return Json(model) if path.endswith(".json") else Pieces(model)


def frequent_keys(docs: DataFrame, tokenizer: Pieces | Json, sample_docs: int = SAMPLE_DOCS) -> dict[str, int]:
    """Token counts of the TABLE_KEYS most frequent pre-tokens of a sample of documents."""
    rows = docs.count()
    if not rows or not tokenizer.splits:
        return {}
    share = min(1.0, sample_docs / rows)
    held = Shared(docs.sparkSession, tokenizer)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column("text"):
                for keys in held.value.keys(text.as_py() or ""):
                    seen.update(k for k in keys if len(k) <= KEY_CHARS)
                if len(seen) > 20 * SAMPLE_KEYS:
                    seen = Counter(dict(seen.most_common(10 * SAMPLE_KEYS)))
        top = seen.most_common(SAMPLE_KEYS)
        yield pa.record_batch({"key": pa.array([k for k, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    found: Counter = Counter()
    for row in docs.select("doc_id", "text").filter(place < share).select("text").mapInArrow(tally, "key string, n long").toArrow().to_pylist():
        found[row["key"]] += row["n"]
    keys = [k for k, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:TABLE_KEYS]]
    return {k: tokenizer.length(k) for k in keys}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 4096, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text)."""
    tokenizer = load_tokenizer(tokenizer_path)
    docs = docs.select("doc_id", "text")
    held = Shared(docs.sparkSession, Lengths(tokenizer, frequent_keys(docs, tokenizer, sample_docs)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [held.value.of(text.as_py() or "") for text in b.column("text")]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes"), "n_tokens": pa.array(n, pa.int64())})

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
