"""LM scoring by partial matching over bytes (PPM).

A text is scored as its lower-cased words joined by one blank and closed by
a line end; the ORDER line ends before it are its first context.  The model is the byte-context trie of
all training texts up to ORDER bytes of context: the deepest nodes count
occurrences, the others in how many one byte longer contexts a symbol was seen
(update exclusion).  A symbol not seen in a context escapes to the next
shorter one with probability ESCAPE times d / n (d symbols seen n times, each
giving up ESCAPE of its count), and the symbols seen in the longer context
are excluded there; below the empty context every byte is as likely.

The trie grows with the corpus, so no task and no broadcast holds it.
Batches of documents name the distinct runs of ORDER + 1 bytes and the
distinct words that they hold, with training counts, to places by hash.  There equal runs of all batches become
one, and each goes on once to the place of the last two
bytes of its context, where all its contexts of two bytes or more
meet (those of one byte and none have 65,792 entries at most and are
broadcast).  What a frequent pair of bytes brings together is thus the distinct runs of the corpus, not
those of every batch.  The code length of each run is computed there, goes back to the run's
place by hash, and from there to the batches that named it.  Words stay in their places by hash, for the base score.

Edge cases: null and empty texts are one end token; without a training row
every count is 0; held-out rows are scored only; repeated rows each get a row; a null doc_id is a fold of its own, that of the
empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Shared, text_bytes
from .textkit import U, Words, breaks, column_bytes, is_long, mix, pieces

ORDER = 5
#: What a symbol gives up of its count to symbols not seen; 0.2 to 0.4 score held-out texts best.
ESCAPE = 0.3
END, BLANK = 10, 32
#: Bytes of text in a batch, and of those that are read at once, whose equal runs are merged.
BATCH_BYTES, PIECE = 8 << 20, 1 << 20
END_TOKEN = 0x5EED0E2D0C2B1A29


def normal_form(w: Words, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(runs, row) of every scored position: its byte and the ``order`` bytes before it as one integer."""
    size = w.end - w.start
    empty = w.per_row == 0
    before = np.cumsum(empty) - empty
    at = np.cumsum(size) - size + np.arange(len(size)) + before[w.row] + order * (w.row + 1)
    total = int(size.sum()) + len(size) + int(empty.sum()) + order * w.rows
    out = np.full(total, END, np.uint64)
    heads = np.cumsum(size) - size
    if len(size):
        out[np.repeat(at - heads, size) + np.arange(int(size.sum()))] = w.low[w.solid]
        inner = np.flatnonzero(w.row[1:] == w.row[:-1])
        out[at[inner] + size[inner]] = BLANK
    letters = np.bincount(w.row, size, w.rows).astype(np.int64) + w.per_row + empty + order
    row = np.repeat(np.arange(w.rows), letters)
    scored = np.ones(total, bool)
    first = np.cumsum(letters) - letters
    scored[(first[:, None] + np.arange(order)).ravel()] = False
    return _runs(out, order)[scored[order:]], row[scored]


def _runs(out: np.ndarray, order: int) -> np.ndarray:
    """Every byte of ``out`` from place ``order`` on, with the bytes before it, as one integer."""
    runs = np.zeros(max(0, len(out) - order), np.uint64)
    for j in range(order + 1):
        runs |= out[j:len(out) - order + j] << U(8 * (order - j))
    return runs


@dataclass
class Part:
    """Some rows from ``first`` on: word hashes and runs with their rows, and the end tokens of each row."""

    first: int
    rows: int
    hash: np.ndarray
    word_row: np.ndarray
    runs: np.ndarray
    run_row: np.ndarray
    ends: np.ndarray


def parts_of(buf: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> Iterator[Part]:
    """All rows in parts; a long row comes in several, the last of which has its end token."""
    for i, b, o in pieces(buf, offsets, PIECE):
        if not is_long(o):
            w = Words(b, o)
            runs, row = normal_form(w, order)
            yield Part(i, w.rows, w.hash, w.row, runs, row, np.ones(w.rows, np.int64))
            continue
        cuts, before, begun = breaks(b, PIECE), np.full(order, END, np.uint64), False
        for a, z in zip(cuts, cuts[1:]):
            w = Words(b[a:z], np.array([0, z - a]))
            runs, _ = normal_form(w, order)
            out = runs & U(255)  # words joined by blanks, and an end
            out = out[:-1] if len(w.hash) else out[:0]
            lead = np.full(int(begun and len(out) > 0), BLANK, np.uint64)
            last = np.full(int(z == len(b)), END, np.uint64)
            whole = np.concatenate([before, lead, out, last])
            runs = _runs(whole, order)
            before, begun = whole[len(whole) - order:], begun or len(out) > 0
            yield Part(i, 1, w.hash, w.row, runs, np.zeros(len(runs), np.int64), np.full(1, int(z == len(b))))


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, counts summed."""
    if not len(keys):
        return keys, counts
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[head], np.add.reduceat(counts, head)


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether there) of each wanted among sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


class Level:
    """The nodes of one context length: their symbols' counts, n and d, and what their symbols count one byte shorter."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts  # (context << 8 | symbol), sorted
        context = keys >> U(8)
        head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.head, self.context = head, context[head]
        self.n = np.add.reduceat(counts, head) if len(head) else counts[:0]
        self.d = np.diff(np.append(head, len(keys)))
        self.shorter = np.zeros(len(head), np.int64)

    def link(self, lower: Level, order: int) -> None:
        """Fill ``shorter``; ``order`` is the length of this level's contexts."""
        if len(self.keys):
            place, _ = found(lower.keys, self.keys & U((1 << 8 * order) - 1))
            self.shorter = np.add.reduceat(lower.counts[place], self.head)


def one_shorter(level: Level, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the next shorter contexts: in how many contexts of ``order`` bytes each symbol was seen."""
    return counted(level.keys & U((1 << 8 * order) - 1), np.ones(len(level.keys), np.int64))


def code_lengths(runs: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of each run's last byte; levels[k]: contexts of k bytes."""
    order = len(levels) - 1
    out, open_ = np.zeros(len(runs)), np.ones(len(runs), bool)
    ex_n, ex_d = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
    for k in range(order, -1, -1):
        level = levels[k]
        key = runs & U((1 << 8 * (k + 1)) - 1)
        node, seen = found(level.context, key >> U(8))
        place, there = found(level.keys, key)
        if not len(level.context):
            continue
        n, d = level.n[node] - ex_n, level.d[node] - ex_d
        active = open_ & seen & (n > 0)
        hit = active & there
        out[hit] += np.log10((level.counts[place[hit]] - ESCAPE) / n[hit])
        miss = active & ~there
        out[miss] += np.log10(ESCAPE * d[miss] / n[miss])
        open_ &= ~hit
        ex_n, ex_d = np.where(seen, level.shorter[node], 0), np.where(seen, level.d[node], 0)
    rest = 256 - (levels[0].d[0] if len(levels[0].d) else 0)
    out[open_] -= np.log10(max(1, rest))
    return out


class Table:
    """Open addressing from 64-bit keys to numbers, by arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.2))))
        self.keys, self.values = np.full(1 << self.bits, U(2**64 - 1)), np.zeros(1 << self.bits, values.dtype)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == U(2**64 - 1)
            self.keys[slot[left[free]]] = keys[left[free]]
            self.values[slot[left[free]]] = values[left[free]]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys * U(0x9E3779B97F4A7C15)
        return ((h ^ (h >> U(29))) >> U(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.values[slot]
        left = np.flatnonzero(self.keys[slot] != keys)
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.values[slot[left]]
            left = left[self.keys[slot[left]] != keys[left]]
        return out


def packed(values: np.ndarray) -> bytes:
    """Integers, sorted ones as steps, with bytes of equal weight together: most are 0, which shuffle files compress away."""
    return np.ascontiguousarray(np.diff(values, prepend=values.dtype.type(0)).view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()


def unpacked(column, kind) -> tuple[np.ndarray, list[int]]:
    """The integers of every row of a column of ``packed``, and how many each row had."""
    size, parts = np.dtype(kind).itemsize, []
    for x in column.to_pylist():
        planes = np.frombuffer(x, np.uint8).reshape(size, -1)
        parts.append(np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind))
    return np.concatenate(parts) if parts else np.zeros(0, kind), [len(x) for x in parts]


def _dealt(kind: int, place: np.ndarray, keys: np.ndarray, values: np.ndarray, batch: int):
    """Rows (kind, place, batch, keys, values), one for each place; keys are sorted within each."""
    by = np.argsort(place, kind="stable")
    place, keys, values = place[by], keys[by], values[by]
    ids, cut = np.unique(place, return_index=True)
    cut = [*cut, len(place)]
    whole = values.dtype != np.float32
    return [(kind, int(p), batch, packed(keys[a:z]), packed(values[a:z]) if whole else values[a:z].tobytes()) for p, a, z in zip(ids, cut, cut[1:])]


_SCHEMA = pa.schema([("kind", pa.int32()), ("place", pa.int64()), ("batch", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
#: kinds of rows.
WORDS, RUNS = range(2)


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _SCHEMA)], schema=_SCHEMA)


def corpus_sums(docs: DataFrame, places: int) -> tuple[list[Level], int, int]:
    """The levels of no byte and one byte of context (65,792 entries at most), training tokens and training types, from docs (text, train)."""
    schema = "kind int, place long, keys binary, n long"
    fields = pa.schema([("kind", pa.int32()), ("place", pa.int64()), ("keys", pa.binary()), ("n", pa.int64())])

    def table(rows: list[tuple]) -> pa.Table:
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, fields)], schema=fields)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's distinct runs of three bytes and distinct words; n of the words' rows: its tokens, once."""
        seen, words, tokens = np.zeros(1 << 24, bool), [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for part in parts_of(*column_bytes(batch.column("text")), 2):
                seen[part.runs.astype(np.int64)] = True
                words.append(np.unique(part.hash))
                tokens += len(part.hash) + int(part.ends.sum())
            words = [np.unique(np.concatenate(words))]
        rows = []
        for kind, keys in ((WORDS, np.append(words[0], U(END_TOKEN)) if tokens else words[0]), (RUNS, np.flatnonzero(seen).astype(np.uint64))):
            for _, place, _, k, _ in _dealt(kind, (mix(keys) % U(places)).astype(np.int64), keys, keys, 0):
                rows.append((kind, place, k, tokens))
                tokens = 0
        yield from table(rows).to_batches()

    def merge(key, t):
        """Of one place: in how many contexts of two bytes each pair was seen, or how many words (-1) and tokens (-2) there are."""
        keys = np.unique(unpacked(t["keys"], np.uint64)[0])
        if key[0].as_py() == WORDS:
            return pa.table({"key": pa.array([-1, -2], pa.int64()), "n": pa.array([len(keys), sum(t["n"].to_pylist())], pa.int64())})
        keys, counts = counted(keys & U(0xFFFF), np.ones(len(keys), np.int64))
        return pa.table({"key": keys.astype(np.int64), "n": counts})

    merged = docs.filter("train").select("text").mapInArrow(distinct, schema).groupBy("kind", "place").applyInArrow(merge, "key long, n long")
    got = dict(merged.groupBy("key").agg(F.sum("n")).collect())  # 65,538 rows at most
    types, tokens = got.pop(-1, 0), got.pop(-2, 0)
    total = np.zeros(1 << 16, np.int64)
    for key, n in got.items():
        total[key] = n
    keys = np.flatnonzero(total)
    first = Level(keys.astype(np.uint64), total[keys])
    root = Level(*one_shorter(first, 1))
    first.link(root, 1)
    return [root, first], tokens, types


def score_texts(docs: DataFrame, training: Column, order: int = ORDER) -> DataFrame:
    """docs (doc_id, text) with held_out, n_tokens, n_known, train_tokens, base_score, score; ``training`` picks what is learned from."""
    spark = docs.sparkSession
    _, nbytes = text_bytes(docs)
    batches = 6 + nbytes // BATCH_BYTES
    places = 6 + nbytes // BATCH_BYTES
    docs = docs.select("doc_id", "text", training.alias("train"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).alias("batch"))

    short, tokens, types = corpus_sums(docs, places)
    small = Shared(spark, short)

    def name(key, t):
        """What a batch holds: distinct runs and words, with training counts."""
        train = t["train"].to_numpy().astype(bool)
        buf, off = column_bytes(t["text"])
        parts = {WORDS: [], RUNS: []}
        for part in parts_of(buf, off, order):
            mine = train[part.first:part.first + part.rows]
            flagged = part.runs << U(1) | mine[part.run_row].astype(np.uint64)
            flagged.sort()
            head = np.flatnonzero(np.concatenate([[True], flagged[1:] != flagged[:-1]]))
            many = np.diff(np.append(head, len(flagged))) * (flagged[head] & U(1)).astype(np.int64)
            parts[RUNS].append(counted(flagged[head] >> U(1), many))
            parts[WORDS].append(counted(np.append(part.hash, U(END_TOKEN)), np.append(mine[part.word_row].astype(np.int64), (mine * part.ends).sum())))
        rows = []
        for kind, found_ in parts.items():
            keys, counts = counted(np.concatenate([k for k, _ in found_]), np.concatenate([c for _, c in found_]))
            rows += _dealt(kind, (mix(keys) % U(places)).astype(np.int64), keys, counts.astype(np.int32), key[0].as_py())
        return _rows(rows)

    schema = "kind int, place long, batch long, keys binary, counts binary"
    named = docs.groupBy("batch").applyInArrow(name, schema)

    def merge(key, t):
        """The runs of a place by hash, each once with its count in all batches, dealt by context."""
        if key[0].as_py() == WORDS:
            return _rows([])
        keys, counts = counted(unpacked(t["keys"], np.uint64)[0], unpacked(t["counts"], np.int32)[0].astype(np.int64))
        return _rows(_dealt(RUNS, (mix(keys >> U(8) & U(0xFFFF)) % U(places)).astype(np.int64), keys, counts, 0))

    def encode(key, t):
        """The code length of each run, dealt by its hash."""
        keys, counts = counted(unpacked(t["keys"], np.uint64)[0], unpacked(t["counts"], np.int64)[0])
        levels = {order: Level(keys[counts > 0], counts[counts > 0])}
        for k in range(order, 2, -1):
            levels[k - 1] = Level(*one_shorter(levels[k], k))
        levels[0], levels[1] = small.value
        for k in range(order, 1, -1):
            levels[k].link(levels[k - 1], k)
        values = code_lengths(keys, [levels[k] for k in range(order + 1)]).astype(np.float32)
        return _rows(_dealt(RUNS, (mix(keys) % U(places)).astype(np.int64), keys, values, 0))

    # both uses of named.groupBy("kind", "place") read the same exchange
    encoded = named.groupBy("kind", "place").applyInArrow(merge, schema).groupBy("place").applyInArrow(encode, schema)

    def answer(key, left, right):
        """The code length of each run, or the training count of each word, for every batch that named it."""
        named_, sizes = unpacked(left["keys"], np.uint64)
        batch, kind = np.repeat(left["batch"].to_numpy(), sizes), key[0].as_py()
        if kind == WORDS:
            keys, values = counted(named_, unpacked(left["counts"], np.int32)[0].astype(np.int64))
        else:
            keys, values = unpacked(right["keys"], np.uint64)[0], np.frombuffer(b"".join(right["counts"].to_pylist()), np.float32)
            by = np.argsort(keys, kind="stable")
            keys, values = keys[by], values[by]
        place, _ = found(keys, named_)
        return _rows([(kind, 0, b, k, v) for _, b, _, k, v in _dealt(kind, batch, named_, values[place], 0)])

    answers = named.groupBy("kind", "place").cogroup(encoded.groupBy("kind", "place")).applyInArrow(answer, schema)

    def score(left, right):
        buf, off = column_bytes(left["text"])
        kind = right["kind"].to_numpy()
        tables = []
        for k in (WORDS, RUNS):
            mine = right.filter(pa.array(kind == k))
            values = unpacked(mine["counts"], np.int64)[0].astype(np.float64) if k == WORDS else np.frombuffer(b"".join(mine["counts"].to_pylist()), np.float32)
            tables.append(Table(unpacked(mine["keys"], np.uint64)[0], values))
        size = len(off) - 1
        n, known, base, total = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
        end = tables[0][np.array([END_TOKEN], np.uint64)][0] if size else 0
        level = np.log10(tokens + types + 1)
        for part in parts_of(buf, off, order):
            at = slice(part.first, part.first + part.rows)
            c = tables[0][part.hash].astype(np.float64)
            n[at] += np.bincount(part.word_row, minlength=part.rows) + part.ends
            known[at] += np.bincount(part.word_row, c > 0, part.rows).astype(np.int64) + int(end > 0) * part.ends
            base[at] += np.bincount(part.word_row, np.log10(c + 1) - level, part.rows) + (np.log10(end + 1) - level) * part.ends
            total[at] += np.bincount(part.run_row, tables[1][part.runs], part.rows)
        return pa.table({"doc_id": left["doc_id"], "held_out": pa.array(~left["train"].to_numpy().astype(bool)), "n_tokens": n, "n_known": known, "train_tokens": np.full(size, tokens), "base_score": base, "score": total})

    # the texts are dealt to their batches once: both uses of docs.groupBy("batch") read the same exchange
    return docs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
