"""Suffix-array dedup: every byte covered by a string of LENGTH bytes that also starts anywhere else is removed.

1. Winnowing marks places: among any RUN-byte grams that start inside a
   window of WINDOW places, the one of least hash.  A string of LENGTH bytes holds a
   whole window, so its occurrences share a mark at the same offset, and lie whole
   within the LEFT bytes before the mark and the LENGTH bytes from it: the mark's context.
2. Marks are gathered by gram.  A context that occurs twice is repeated
   throughout.  Contexts that occur once among others of the same gram are open.
3. Open contexts, and one of each repeated context beside them, are sorted by two suffix
   arrays, one over what follows the marks and one over what precedes them, read backwards.
   Symbols are blocks of bytes, numbered in byte order, so the order is that of the bytes.
   Contexts whose neighbours in an order agree in d bytes or more make an interval of
   depth d.  A string of LENGTH bytes that starts t bytes before its mark is repeated
   if another context shares its interval of depth LENGTH - t in the one order and of depth t in the other.
4. Spans go back to their documents, are joined, and cut out.

Suffix sorting (Baier 2016): suffixes start in groups by first symbol;
groups are taken in descending order, each suffix finds the nearest suffix before it
of a lower group (its previous-smaller pointer), and those are moved up
within their groups by how many pointers they get.  Then every group holds suffixes of one
Lyndon prefix, and one ascending pass emits each group's order: a suffix comes
when the suffix behind its Lyndon prefix has come.  Nothing is renamed or sorted again.

Open contexts of a gram meet in one task (about 400 bytes each) where the gram
has at most GRAM_MOST contexts.  Larger grams are divided.  The strings of LENGTH bytes that
start t bytes before a mark, for a band of ``width`` neighbouring t, have LENGTH - width + 1 bytes in
common, their core, and two contexts can only share one of them if they share its core.  So contexts are
dealt by band and core, each with the ring of width - 1 bytes on either side of the core, and rings
of a core are sorted by the two suffix arrays as whole contexts are.  Equal rings of a batch go
as one.  Grams of more than 64 * GRAM_MOST contexts have bands of two offsets: a ring is one byte
on either side then, so a core has at most 257 * 257 of them, however many contexts share it.
Marks (40 bytes each) still meet by gram; equal contexts, and equal rings, meet once for each input batch.
A row is known by two independent 64-bit hashes of doc_id and text: one picks its batch, one finds it there.

Edge cases: null and empty texts have no byte and the SHA-256 of nothing; texts
under LENGTH bytes keep all; matches never cross documents; repeated rows
are documents of their own, so all their strings of LENGTH bytes are repeats; a long text is
marked in parts that overlap; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored, text_bytes
from .textkit import _BASE, U, column_bytes, mix, pieces, powers

LENGTH, RUN = 200, 32
WINDOW = LENGTH - RUN + 1
LEFT = WINDOW - 1
#: Bytes of a symbol after the marks, and before them.
BLOCK, LEFT_BLOCK = 40, 42
POSITION_BITS = 31
#: Bytes of text in a batch, and that are marked at a time.
BATCH_BYTES, MARKED = 8 << 20, 1 << 20
#: Contexts of a gram that may meet in one task, and contexts or rings that are handled at a time.
GRAM_MOST, CHUNK = 4096, 8192
#: Neighbouring offsets of a band, for large and for very large grams.
WIDE, NARROW = 34, 2
_INVERSE = pow(_BASE, -1, 1 << 64)
_inverse = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        p = np.full(max(n, 1024), U(_INVERSE))
        p[0] = 1
        _inverse = np.cumprod(p, dtype=np.uint64)
    return _inverse[:n]


class Hashes:
    """Hashes of substrings of some bytes, from running sums."""

    def __init__(self, b: np.ndarray):
        self.sums = np.concatenate([[U(0)], np.cumsum((b.astype(np.uint64) + U(1)) * powers(len(b)), dtype=np.uint64)])
        self.back = inverse_powers(len(b) + 1)

    def __call__(self, at: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[at + size] - self.sums[at]) * self.back[at])


def marks(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, place in the row, gram hash, context hash, of every mark; and the context's (left, right) bytes as an n x 2 array."""
    n, h = len(b), Hashes(b)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64), np.zeros((0, 2), np.int64)
    places = np.arange(n - RUN + 1)
    gram = h(places, RUN)
    top = U((1 << POSITION_BITS) - 1)
    key = (gram & ~top) | (top - places.astype(np.uint64))
    # least key of each window, from running minima of fixed blocks
    padded = np.concatenate([key, np.full(-len(key) % WINDOW, U(2**64 - 1))]).reshape(-1, WINDOW)
    ahead, behind = np.minimum.accumulate(padded, 1).ravel(), np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    windows = len(key) - WINDOW + 1
    least = np.minimum(behind[:windows], ahead[WINDOW - 1:WINDOW - 1 + windows])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:windows] == row[LENGTH - 1:LENGTH - 1 + windows]
    at = np.unique((top - (least[inside] & top)).astype(np.int64))
    rows = row[at]
    left, right = np.minimum(LEFT, at - offsets[rows]), np.minimum(LENGTH, offsets[rows + 1] - at)
    return rows, at - offsets[rows], gram[at], h(at - left, left + right) ^ mix((left * 1024 + right).astype(np.uint64)), np.stack([left, right], 1)


def mark_parts(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    """What ``marks`` gives for all rows, in parts; a long row is marked in stretches, each with the bytes around it that its marks depend on."""
    for i, b, o in pieces(buf, offsets, MARKED):
        if len(b) <= 2 * MARKED:
            row, *rest = marks(b, o)
            yield i + row, *rest
            continue
        for c in range(0, len(b), MARKED):
            low = max(0, c - LEFT)
            part = b[low:c + MARKED + LENGTH + WINDOW]
            row, at, *rest = marks(part, np.array([0, len(part)]))
            own = (at + low >= c) & (at + low < c + MARKED)
            yield i + row[own], at[own] + low, *(x[own] for x in rest)


UNSET = -2


def suffix_array(s: np.ndarray) -> list[int]:
    """Starts of the suffixes of s in order.  s ends with a symbol that is smaller than all others."""
    n = len(s)
    start_order = np.argsort(s, kind="stable")
    head = np.concatenate([[True], s[start_order][1:] != s[start_order][:-1]])
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    groups, places = np.empty(n, np.int64), np.empty(n, np.int64)
    groups[start_order], places[start_order] = first, np.arange(n)
    sa, group, place = start_order.tolist(), groups.tolist(), places.tolist()
    size = np.bincount(first, minlength=n).tolist()
    previous, jump, lyndon = [-1] * n, [UNSET] * n, [1] * n
    high = n
    while high:
        start = group[sa[high - 1]]
        pointers: dict[int, int] = {}
        for i in sa[start:high]:
            j = jump[i]
            if j == UNSET:
                path, j = [i], i - 1
                while j >= 0 and group[j] >= start:
                    path.append(j)
                    j = jump[j] if jump[j] != UNSET else j - 1
                for x in path:
                    jump[x] = j
            previous[i] = j
            if j >= 0:
                lyndon[j] += lyndon[i]
                pointers[j] = pointers.get(j, 0) + 1
        least = 1
        moving = list(pointers)
        while moving:  # those with more pointers into this group go further up
            moved: dict[int, list[int]] = {}
            for p in moving:
                g = group[p]
                size[g] -= 1
                a, z = place[p], g + size[g]
                other = sa[z]
                sa[a], sa[z] = other, p
                place[other], place[p] = a, z
                moved.setdefault(g, []).append(p)
            for g, members in moved.items():
                new = g + size[g]
                size[new] = len(members)
                for p in members:
                    group[p] = new
            least += 1
            moving = [p for p in moving if pointers[p] >= least]
        high = start
    out, free = [0] * n, list(range(n))
    out[0] = n - 1
    for k in range(n):
        r = out[k]
        i = r - 1
        while i >= 0 and i + lyndon[i] == r:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            i = previous[i]
    return out


def sorted_rows(rows: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of each row in the order of the suffix array over all rows, bytes that the row at each place shares with the one before it)."""
    m, width = rows.shape
    _, number = np.unique(rows.view(f"S{block}"), return_inverse=True)
    number = number.reshape(m, width // block) + 2
    order = np.array(suffix_array(np.append(np.concatenate([number, np.ones((m, 1), np.int64)], 1).ravel(), 0)))
    step = width // block + 1
    order = order[(order % step == 0) & (order < m * step)] // step
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    differs = rows[order[1:]] != rows[order[:-1]]
    return place, np.append(0, np.where(differs.any(1), differs.argmax(1), width))


def around(text: np.ndarray, mark: np.ndarray, step: int, length: np.ndarray, width: int) -> np.ndarray:
    """For each mark the ``length`` bytes from it on (step 1) or before it backwards (step -1), filled up to ``width`` with zeros."""
    out = np.zeros((len(mark), width), np.uint8)
    for a in range(0, len(mark), CHUNK):
        reach = np.arange(width)
        there = reach < length[a:a + CHUNK, None]
        at = mark[a:a + CHUNK, None] + (reach if step > 0 else -1 - reach)
        out[a:a + CHUNK] = np.where(there, text[np.where(there, at, 0)], 0)
    return out


def repeated_offsets(text: np.ndarray, offsets: np.ndarray, left: np.ndarray) -> list[tuple[int, int, int]]:
    """(context, start, end) of repeated strings, joined where neighbours, relative to the mark; text: the contexts, one after the other."""
    mark = offsets[:-1] + left
    right = offsets[1:] - mark
    return repeats_in_order(around(text, mark, 1, right, LENGTH), BLOCK, around(text, mark, -1, left, LEFT), LEFT_BLOCK, left, right, LENGTH)


def repeats_in_order(after: np.ndarray, block: int, before: np.ndarray, left_block: int, left: np.ndarray, right: np.ndarray, length: int, head: int = 0) -> list[tuple[int, int, int]]:
    """What ``repeated_offsets`` gives, for strings of ``length`` bytes.  after, before: what follows each mark and, backwards, what precedes it; the first ``head`` bytes of after are no part of the string but have to agree."""
    m = len(left)
    after, agree_after = sorted_rows(after, block)
    before, agree_before = sorted_rows(before, left_block)
    spans = []
    open_at = np.full(m, -1)
    for t in range(int(left.max(initial=-1)), -2, -1):
        here = np.zeros(m, bool)
        if t >= 0:
            c = np.flatnonzero((left >= t) & (right >= length - t))
            key = np.cumsum(agree_after < head + length - t)[after[c]] * (m + 1) + np.cumsum(agree_before < t)[before[c]]
            _, back, times = np.unique(key, return_inverse=True, return_counts=True)
            here[c[times[back] > 1]] = True
        for c in np.flatnonzero(here & (open_at < 0)):
            open_at[c] = t
        for c in np.flatnonzero(~here & (open_at >= 0)):
            spans.append((int(c), -int(open_at[c]), length - t - 1))
            open_at[c] = -1
    return spans


def rings(gram: np.ndarray, text: np.ndarray, offsets: np.ndarray, left: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """context, first offset of the band, and bytes of every ring: hash of the core, what follows the core, what precedes it backwards, and how many bytes there are of the one (as 1 more) and the other."""
    w, h, mark = width - 1, Hashes(text), offsets[:-1] + left
    right = offsets[1:] - mark
    parts = []
    for low in range(0, LEFT + 1, width):
        high = low + w
        c = np.flatnonzero(np.maximum(low, LENGTH - right) <= np.minimum(high, left))
        core = mix(h(mark[c] - low, LENGTH - w) + mix(gram[c] + U(low * 256 + width)))
        before, after = np.minimum(left[c] - low, w), np.minimum(right[c] - LENGTH + high, w)
        ring = np.concatenate([
            core[:, None].view(np.uint8), around(text, mark[c] + LENGTH - high, 1, after, w), around(text, mark[c] - low, -1, before, w), np.stack([before, after + 1], 1).astype(np.uint8),
        ], 1)
        parts.append((c, np.full(len(c), low), ring))
    context, low, ring = (np.concatenate(x) for x in zip(*parts))
    return context, low, ring


def distinct_rings(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What np.unique gives for the rows: a row of each value, in the order of their cores; the value of each row; times.  No ring ends in a zero byte."""
    _, first, back, times = np.unique(np.ascontiguousarray(ring).view(f"S{ring.shape[1]}").ravel(), return_index=True, return_inverse=True, return_counts=True)
    return first, back, times


def ring_sides(ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes there are before and after the core."""
    return ring[:, -2].astype(np.int64), ring[:, -1].astype(np.int64) - 1


def repeated_rings(ring: np.ndarray) -> list[tuple[int, int, int]]:
    """(ring, start, end) of repeated strings, relative to the first byte before which the band's first string starts; ring: different ones, in the order of their cores."""
    w = (ring.shape[1] - 10) // 2
    core = ring[:, :8].copy().view(np.uint64).ravel()
    new = np.flatnonzero(np.append(True, core[1:] != core[:-1])) if len(core) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(core)))
    shared = np.flatnonzero(np.repeat(size, size) > 1)
    heads = np.flatnonzero(np.append(True, core[shared][1:] != core[shared][:-1])) if len(shared) else shared
    # whole cores, about CHUNK rings at a time
    cuts = [0]
    for head in [*heads[1:], len(shared)]:
        if head - cuts[-1] >= CHUNK or head == len(shared):
            cuts.append(head)
    spans = []
    for a, z in zip(cuts, cuts[1:]):
        mine = shared[a:z]
        before, after = ring_sides(ring[mine])
        block, left_block = -(-(8 + w) // 2), -(-w // 2)
        follows, precedes = (np.pad(x, ((0, 0), (0, 2 * b - x.shape[1]))) for x, b in ((ring[mine, :8 + w], block), (ring[mine, 8 + w:8 + 2 * w], left_block)))
        spans += [(int(mine[i]), begin, end + LENGTH - w) for i, begin, end in repeats_in_order(follows, block, precedes, left_block, before, after, w, 8)]
    return spans


_SCHEMA = "kind int, place long, a binary, b binary, c binary, d binary"
_ARROW = pa.schema([("kind", pa.int32()), ("place", pa.int64()), *((x, pa.binary()) for x in "abcd")])
#: kind: marks to gather (gram, context; row, batch and packed place, sides and 1 if known to be repeated); spans of a batch (row, start and end); contexts that a batch is asked for (row, place, gram, 1 if open and 2 if of a large gram and 4 if of a very large one); contexts (gram, facts, bytes); rings of bands of WIDE and of NARROW offsets (row, batch, place and offset and 1 if open and 2 if known to be repeated; bytes).
MARKS, SPANS, ASKED, CONTEXTS, WIDE_RINGS, NARROW_RINGS = range(6)


def _dealt(kind: int, place: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Rows for each place; of a table of numbers column after column, which shuffle files compress better."""
    by = np.argsort(place, kind="stable")
    place, columns = place[by], [c[by] for c in columns]
    ids, cut = np.unique(place, return_index=True)
    cut = [*cut, len(place)]
    return [(kind, int(p), *(c[a:z].T.tobytes() for c in columns), *[None] * (4 - len(columns))) for p, a, z in zip(ids, cut, cut[1:])]


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, _ARROW)], schema=_ARROW)


def _read(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def _read_table(column, width: int) -> np.ndarray:
    """The columns of a table of integers."""
    return np.concatenate([np.zeros((width, 0), np.int64), *(np.frombuffer(x, np.int64).reshape(width, -1) for x in column.to_pylist() if x)], axis=1)


def ring_spans(at: np.ndarray, low: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Start and end in the row of all strings of a band."""
    before, after = ring_sides(ring)
    return np.stack([at - low - before, at - low + LENGTH - (ring.shape[1] - 10) // 2 + after], 1)


def _read_bytes(column, width: int) -> np.ndarray:
    """The rows of a table of bytes that was sent column by column."""
    return np.concatenate([np.zeros((0, width), np.uint8), *(np.frombuffer(x, np.uint8).reshape(width, -1).T for x in column.to_pylist() if x)])


def cut_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text); with_text: and kept, the remaining bytes."""
    _, nbytes = text_bytes(docs)
    places = 6 + nbytes // BATCH_BYTES
    most = GRAM_MOST
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), F.pmod(F.xxhash64(F.lit(1), "text", "doc_id"), F.lit(places)).alias("batch"))

    def mark(input_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrived in input_:
            buf, off = column_bytes(arrived.column("text"))
            key, home = arrived.column("row").to_numpy(), arrived.column("batch").to_numpy()
            parts = list(mark_parts(buf, off))
            if not parts:
                continue
            row, at, gram, context, sides = (np.concatenate(x) for x in zip(*parts))
            del parts
            by = np.lexsort((context, gram))
            row, batch, at, gram, context, sides = key[row[by]], home[row[by]], at[by], gram[by], context[by], sides[by]
            head = np.ones(len(row), bool)
            head[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
            start = np.flatnonzero(head)
            times = np.diff(np.append(start, len(row)))
            many = np.repeat(times, times) > 1
            span = np.stack([at - sides[:, 0], at + sides[:, 1]], 1).astype(np.int64)
            rows = _dealt(SPANS, batch[many], row[many], span[many])
            # one of each context goes on, with whether it is known to be repeated
            packed = np.stack([row[start], batch[start], at[start] << 17 | sides[start, 0] << 9 | sides[start, 1] << 1 | (times > 1)], 1).astype(np.int64)
            rows += _dealt(MARKS, (gram[start] % U(places)).astype(np.int64), gram[start], context[start], packed)
            yield from _rows(rows).to_batches()

    marked = stored(docs.select("text", "row", "batch").mapInArrow(mark, _SCHEMA))

    def gather(key, t):
        gram, context = _read(t["a"], np.uint64), _read(t["b"], np.uint64)
        by = np.lexsort((context, gram))
        gram, context = gram[by], context[by]
        row, batch, rest = _read_table(t["c"], 3)[:, by]
        at, left, right, known = rest >> 17, rest >> 9 & 255, rest >> 1 & 255, rest & 1 == 1
        head = np.ones(len(gram), bool)
        head[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
        start = np.flatnonzero(head)
        number = np.cumsum(head) - 1
        full = (np.diff(np.append(start, len(gram))) > 1) | known[start]
        spans = full[number] & ~known
        new = np.ones(len(start), bool)
        new[1:] = gram[start][1:] != gram[start][:-1]
        group = np.cumsum(new) - 1
        contexts, closed = np.bincount(group), np.bincount(group, full)
        asked = start[(contexts[group] > 1) & (closed[group] < contexts[group])]
        meeting = contexts[group[number[asked]]]
        rows = _dealt(SPANS, batch[spans], row[spans], np.stack([at - left, at + right], 1)[spans])
        rows += _dealt(ASKED, batch[asked], row[asked], at[asked], gram[asked], ~full[number[asked]] + 2 * (meeting > most) + 4 * (meeting > 64 * most))
        return _rows(rows)

    gathered = stored(marked.filter(F.col("kind") == MARKS).groupBy("place").applyInArrow(gather, _SCHEMA))

    def fetch(key_, texts, asked):
        """The contexts that were asked for: kind CONTEXTS, by gram; of large grams the rings, and spans of those that are repeated here."""
        home, key = key_[0].as_py(), texts["row"].to_numpy()
        buf, off = column_bytes(texts["text"])
        row, at, gram, flags = (_read(asked[c], k) for c, k in zip("abcd", (np.int64, np.int64, np.uint64, np.int64)))
        if not len(row) or not len(key):
            return _rows([])
        by = np.argsort(key, kind="stable")
        found = by[np.minimum(np.searchsorted(key[by], row), len(key) - 1)]
        begin, end = off[found], off[found + 1]
        left, right = np.minimum(LEFT, at), np.minimum(LENGTH, end - begin - at)
        place = (gram % U(places)).astype(np.int64)
        is_open, large = flags % 2, flags > 1

        def bytes_of(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            size = left[c] + right[c]
            pick = np.repeat(begin[c] + at[c] - left[c] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            return size, buf[pick]

        rows = []
        order = np.flatnonzero(~large)
        order = order[np.argsort(place[order], kind="stable")]
        ids, cut = np.unique(place[order], return_index=True)
        for p, a, z in zip(ids, cut, [*cut[1:], len(order)]):
            c = order[a:z]
            size, text = bytes_of(c)
            rows.append((CONTEXTS, int(p), np.stack([row[c], np.full(len(c), home), at[c], left[c], size, is_open[c]]).astype(np.int64).tobytes(), text.tobytes(), None, None))
        for kind, width, order in ((WIDE_RINGS, WIDE, np.flatnonzero(large & (flags < 4))), (NARROW_RINGS, NARROW, np.flatnonzero(flags >= 4))):
            order = order[np.argsort(gram[order], kind="stable")]
            for a in range(0, len(order), CHUNK):
                c = order[a:a + CHUNK]
                size, text = bytes_of(c)
                context, low, ring = rings(gram[c], text, np.concatenate([[0], np.cumsum(size)]), left[c], width)
                c = c[context]
                first, back, times = distinct_rings(ring)
                again = (times[back] > 1) & (is_open[c] == 1)
                rows += _dealt(SPANS, np.full(again.sum(), home), row[c][again], ring_spans(at[c][again], low[again], ring[again]))
                c, low, ring = c[first], low[first], ring[first]
                core = ring[:, :8].copy().view(np.uint64).ravel()
                rest = at[c] * 1024 + low * 4 + (is_open[c] & (times == 1)) + 2 * (times > 1)
                rows += _dealt(kind, (mix(core) % U(places)).astype(np.int64), np.stack([row[c], np.full(len(c), home), rest], 1), ring)
        return _rows(rows)

    wanted = gathered.filter(F.col("kind") == ASKED).withColumnRenamed("place", "batch")
    contexts = docs.select("row", "text", "batch").filter(F.octet_length("text") >= LENGTH).groupBy("batch").cogroup(wanted.groupBy("batch")).applyInArrow(fetch, _SCHEMA)

    def sort(key, t):
        kind = t["kind"].to_numpy()
        found = t.filter(pa.array(kind == SPANS)).to_batches()
        for mine, width in ((WIDE_RINGS, WIDE), (NARROW_RINGS, NARROW)):
            if not (kind == mine).any():
                continue
            part = t.filter(pa.array(kind == mine))
            (owner, home, rest), ring = _read_table(part["a"], 3), _read_bytes(part["b"], 2 * width + 8)
            at, low, is_open = rest >> 10, rest >> 2 & 255, rest & 1 == 1
            first, back, times = distinct_rings(ring)
            many = (times > 1) | (np.bincount(back, rest >> 1 & 1) > 0)
            again = many[back] & is_open
            found += _rows(_dealt(SPANS, home[again], owner[again], ring_spans(at[again], low[again], ring[again]))).to_batches()
            spans = [(first[i], begin, end) for i, begin, end in repeated_rings(ring[first]) if is_open[first[i]] and not many[i]]
            c = np.array([x[0] for x in spans], np.int64)
            span = np.array([x[1:] for x in spans], np.int64).reshape(-1, 2) + (at - low)[c][:, None]
            found += _rows(_dealt(SPANS, home[c], owner[c], span)).to_batches()
        t = t.filter(pa.array(kind == CONTEXTS))
        if not t.num_rows:
            return pa.Table.from_batches(found, _ARROW)
        text = _read(t["b"], np.uint8)
        row, home, at, left, size, is_open = _read_table(t["a"], 6)
        spans = [s for s in repeated_offsets(text, np.concatenate([[0], np.cumsum(size)]), left) if is_open[s[0]]]
        c = np.array([s[0] for s in spans], np.int64)
        span = np.array([s[1:] for s in spans], np.int64).reshape(-1, 2) + at[c][:, None]
        return pa.Table.from_batches([*found, *_rows(_dealt(SPANS, home[c], row[c], span)).to_batches()], _ARROW)

    sorted_ = contexts.groupBy("place").applyInArrow(sort, _SCHEMA)
    spans = marked.filter(F.col("kind") == SPANS).unionByName(gathered.filter(F.col("kind") == SPANS)).unionByName(sorted_).select(F.col("place").alias("batch"), "a", "b")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def cut_out(texts, found):
        key = texts["row"].to_numpy()
        buf, off = column_bytes(texts["text"])
        row, span = _read(found["a"], np.int64), _read_table(found["b"], 2).T
        by = np.lexsort((span[:, 0], row))
        row, span = row[by], span[by]
        n, removed, runs, digest, kept = np.diff(off), [], [], [], []
        for i in range(len(key)):
            a, z = np.searchsorted(row, key[i], "left"), np.searchsorted(row, key[i], "right")
            text, rest = buf[off[i]:off[i + 1]], hashlib.sha256()
            start, end = span[a:z, 0], np.maximum.accumulate(span[a:z, 1])
            first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]])) if a < z else np.zeros(0, np.int64)
            # what stays lies between the end of one run and the start of the next
            begin = np.append(0, end[np.append(first[1:] - 1, z - a - 1)] if a < z else [])
            stay = [text[x:y].tobytes() for x, y in zip(begin.astype(np.int64), np.append(start[first], len(text)).astype(np.int64))]
            for x in stay:
                rest.update(x)
            runs.append(len(first))
            removed.append(int(n[i]) - sum(map(len, stay)))
            digest.append(rest.hexdigest())
            kept.append(b"".join(stay) if with_text else None)
        out = {"doc_id": texts["doc_id"].cast(pa.int64()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    return docs.groupBy("batch").cogroup(spans.groupBy("batch")).applyInArrow(cut_out, schema)
