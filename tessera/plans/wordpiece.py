"""WordPiece ids of a text column: pre-tokens by expression, greedy longest match in an Arrow job."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.text import pre_tokens


def word_ids(word: str, vocabulary: dict[str, int], unknown: int, longest: int) -> list[int]:
    """Greedy longest match; no piece has more than ``longest`` characters, so the work is linear in the word."""
    ids, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        end = next((e for e in range(min(len(word), at + longest), at, -1) if mark + word[at:e] in vocabulary), None)
        if end is None:
            return [unknown]
        ids.append(vocabulary[mark + word[at:end]])
        at = end
    return ids


def learned_vocabulary(texts: DataFrame, pieces: int = 400, first: int = 4, inner: int = 3) -> dict[str, int]:
    """[PAD], [UNK], [CLS], [SEP], every letter, digit and underscore, first and inner, then the ``pieces`` commonest beginnings and as many commonest inner
    parts of the words of ``texts`` (text), each in alphabetical order."""
    words = texts.select(F.explode(pre_tokens(F.coalesce("text", F.lit("")))).alias("w")).filter(F.col("w").rlike("^[a-z0-9_]{2,}$"))
    singles = "abcdefghijklmnopqrstuvwxyz0123456789_"
    out = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *singles, *(f"##{c}" for c in singles)]
    for piece, mark in ((F.substring("w", 1, first), ""), (F.substring("w", first + 1, inner), "##")):
        best = words.select(piece.alias("p")).filter(F.length("p") > 1).groupBy("p").count().orderBy(F.desc("count"), "p").limit(pieces)
        out += sorted(mark + r["p"] for r in best.collect())  # at most ``pieces`` rows
    return {w: i for i, w in enumerate(out)}


def wordpiece(texts: DataFrame, vocabulary: dict[str, int], most: int = 512) -> DataFrame:
    """texts (id, text) with ids, n_tokens and over (more than ``most`` tokens; such rows have no ids).  The vocabulary has [CLS], [SEP] and [UNK]."""
    held = texts.sparkSession.sparkContext.broadcast(vocabulary)
    longest = max((len(w) - 2 * w.startswith("##") for w in vocabulary), default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for batch in batches:
            ids = [[v["[CLS]"], *(i for w in words or [] for i in word_ids(w, v, v["[UNK]"], longest)), v["[SEP]"]] for words in batch.column("words").to_pylist()]
            yield pa.record_batch({"id": batch.column("id"), "ids": pa.array([x if len(x) <= most else None for x in ids], pa.list_(pa.int32())), "n_tokens": pa.array([len(x) for x in ids], pa.int32()), "over": pa.array([len(x) > most for x in ids])})

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", pre_tokens(F.coalesce("text", F.lit(""))).alias("words")).mapInArrow(run, f"id {kind}, ids array<int>, n_tokens int, over boolean")
