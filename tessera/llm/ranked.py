"""Ranked lexical search by range-maximum tables over posting lists.

Documents lie in blocks of at most BLOCK_DOCS, ordered by doc_id; a block has
one posting list for each term that some item holds, and over the lists'
impacts a sparse table of range maxima.  For an item a block is searched best first: a document interval is bounded by the
sum, over the item's terms, of the greatest impact of each list inside it (two table entries a term), and the interval
of the greatest bound is split at the document of its greatest impact, which is scored exactly; intervals of at most
LEAF documents are scored as they are.  What can't come among the k best any more is dropped: the bound is below the k-th score found, or
equal to it with larger doc_ids only, so ties come out right.  All items of a block are searched at once, WIDTH intervals
of each a round, as vectors.

The blocks of a sixteenth of the table are searched first; the k-th best score found there for an item is a score that the other blocks have
to reach, so most of them end at their first bound.  The result is the same whichever blocks come first.

Documents are read once and never cross the network: a task packs its own into blocks, which are stored.
Items are read by the driver in parts of about ITEM_BYTES (a larger item is a part of its own); documents are read once for each part.

Terms are compared by 64-bit hashes: among 10^10 different terms of documents and 10^5 of items, the chance that any is taken for another is 5e-5.

Edge cases: null texts have no term, and neither have texts of punctuation; an item without a term, or
whose terms no document holds, has no row; rows that repeat an item are items by themselves, each with its own ranks; rows
that repeat a document are documents by themselves; a null doc_id ranks behind others of its score; long texts are
read in stretches; further columns don't matter; empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Shared, stored
from .textkit import PUNCTUATION, Words, breaks, column_bytes, is_long, pieces

#: Documents and postings of a block, documents of a leaf, intervals of an item that are split in a round, bytes of a part of items, terms searched at once.
BLOCK_DOCS, BLOCK_POSTINGS, LEAF, WIDTH, ITEM_BYTES, SEARCH_TERMS = 4096, 1 << 20, 64, 8, 2 << 20, 1 << 17
#: One block in so many is searched first.
PILOT = 16
NO_ID = np.iinfo(np.int64).max


def term_counts(column) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, row of each term, hash of each term, rows) of runs of rows, stretches of a long row one after another."""
    buf, offsets = column_bytes(column)
    for first, b, o in pieces(buf, offsets):
        if is_long(o):
            cuts = breaks(b, gaps=PUNCTUATION)
            for a, z in zip(cuts, cuts[1:]):
                w = Words(b[a:z], np.array([0, z - a]), PUNCTUATION)
                yield first, w.row, w.hash, 1
        else:
            w = Words(b, o, PUNCTUATION)
            yield first, w.row, w.hash, len(o) - 1


@dataclass
class Items:
    """Terms of the items of one part, by hash in ascending order, and each item's term numbers."""

    hashes: np.ndarray
    keys: list[int]
    ptr: np.ndarray
    terms: np.ndarray


def read_items(keys: list[int], texts) -> Items:
    row, h = [], []
    for first, r, x, _ in term_counts(texts):
        row.append(r + first)
        h.append(x)
    row, h = np.concatenate([np.zeros(0, np.int64), *row]), np.concatenate([np.zeros(0, np.uint64), *h])
    hashes, number = np.unique(h, return_inverse=True)
    pair = np.unique(row * max(len(hashes), 1) + number)
    row, terms = pair // max(len(hashes), 1), pair % max(len(hashes), 1)
    return Items(hashes, keys, np.searchsorted(row, np.arange(len(keys) + 1)), terms)


def pack_blocks(docs: DataFrame, items: Items) -> DataFrame:
    """Blocks of documents: their ids and lengths, and by term how many documents of the block hold it, which, and how often."""
    held, count = Shared(docs.sparkSession, items.hashes), len(items.hashes)

    def block(ids, lengths, doc, term, tf) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        doc = place[doc]
        by = np.lexsort((doc, term))
        df = np.bincount(term, minlength=count)
        made = {"ids": ids[order].tobytes(), "lengths": lengths[order].tobytes(), "docs": doc[by].astype(np.int32).tobytes(), "tf": tf[by].astype(np.int32).tobytes()}
        return pa.record_batch({k: pa.array([v], pa.binary()) for k, v in made.items()} | {"df": pa.array([df], pa.list_(pa.int64())), "n_docs": pa.array([int((lengths > 0).sum())], pa.int64()), "n_terms": pa.array([int(lengths.sum())], pa.int64())})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, lengths, found, postings = held.value, [], [], [], 0

        def flush():
            nonlocal ids, lengths, found, postings
            doc, term, tf = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(3))
            out = block(np.array(ids, np.int64), np.array(lengths, np.int64), doc, term, tf)
            ids, lengths, found, postings = [], [], [], 0
            return out

        for b in batches:
            own = b.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_pylist()
            at, tally, last = 0, [], -1
            for first, row, h, rows in [*term_counts(b.column("text")), (len(own), None, None, 0)]:
                if first != last and tally:  # the rows before are complete
                    row_, term, tf = (np.concatenate([t[i] for t in tally]) for i in range(3))
                    n = sum(t[3] for t in tally)
                    if len(tally) > 1:
                        term, to = np.unique(term, return_inverse=True)
                        row_, tf = np.zeros(len(term), np.int64), np.bincount(to, tf, len(term)).astype(np.int64)
                    base = 0
                    while base < len(n):  # as many rows as the block has room for
                        take = min(len(n) - base, BLOCK_DOCS - len(ids))
                        mine = (row_ >= base) & (row_ < base + take)
                        found.append((row_[mine] - base + len(ids), term[mine], tf[mine]))
                        ids += own[at:at + take]
                        lengths += n[base:base + take].tolist()
                        postings += int(mine.sum())
                        at, base = at + take, base + take
                        if len(ids) >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                            yield flush()
                    tally = []
                last = first
                if h is None:
                    break
                n = np.bincount(row, minlength=rows)
                place = np.minimum(np.searchsorted(known, h), max(count - 1, 0))
                hit = known[place] == h if count else np.zeros(len(h), bool)
                pair, tf = np.unique(row[hit] * max(count, 1) + place[hit], return_counts=True)
                tally.append((pair // max(count, 1), pair % max(count, 1), tf, n))
        if ids:
            yield flush()

    schema = "ids binary, lengths binary, docs binary, tf binary, df array<long>, n_docs long, n_terms long"
    return docs.select("doc_id", "text").mapInArrow(pack, schema)


class Lists:
    """The posting lists of a block, one behind the other, with a sparse table of the places of range maxima."""

    def __init__(self, df: np.ndarray, docs: np.ndarray, impact: np.ndarray, size: int):
        self.start, self.docs, self.impact, self.size = np.append(0, np.cumsum(df)), docs, impact, size
        self.key = np.repeat(np.arange(len(df)), df) * size + docs
        self.table = [np.arange(len(docs), dtype=np.int32)]
        while 2 << len(self.table) - 1 <= (int(df.max()) if len(df) else 0):
            half, a = 1 << len(self.table) - 1, self.table[-1]
            far = np.minimum(np.arange(len(a)) + half, len(a) - 1)
            self.table.append(np.where(impact[a] >= impact[a[far]], a, a[far]))
        self.table = np.stack(self.table)

    def top(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of the first greatest impact in each range; -1 of an empty one."""
        out = np.full(len(left), -1, np.int64)
        at = np.flatnonzero(right > left)
        a, b = left[at], right[at]
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        x, y = self.table[level, a], self.table[level, b - (1 << level)]
        out[at] = np.where(self.impact[x] >= self.impact[y], x, y)
        return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, .. of each range, one behind the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(start, size)


def _kept(item: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each item (greatest score, then smallest doc), and their places 0..k-1."""
    order = np.lexsort((doc, -score, item))
    item, score, doc = item[order], score[order], doc[order]
    place = np.arange(len(item)) - np.searchsorted(item, item)
    good = place < k
    return item[good], score[good], doc[good], place[good]


def search_block(lists: Lists, ptr: np.ndarray, terms: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, score, document) of the k best documents of each item that score at least ``floor`` (1 or more)."""
    items = len(floor)
    width = np.diff(ptr)
    got = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, behind = floor.copy(), np.full(items, lists.size, np.int64)  # what an interval has to beat, or equal with documents before ``behind``

    # frontier: item, first and last+1 document, bound, document to split at; the ranges of its terms follow in CSR form
    def bounded(item, lo, hi, left, right):
        place = lists.top(left, right)
        value = np.where(place >= 0, lists.impact[place], 0)
        own = np.repeat(np.arange(len(item)), width[item])
        bound = np.bincount(own, value, len(item)).astype(np.int64) if not len(value) or value.max() < 1 << 40 else np.array([value[own == i].sum() for i in range(len(item))])
        order = np.lexsort((place, -value, own))
        first = np.searchsorted(own[order], np.arange(len(item)))
        split = lists.docs[place[order[first]]] if len(item) else np.zeros(0, np.int64)
        return [item, lo, hi, bound, split.astype(np.int64), left, right]

    def picked(f, mask):
        wide = np.repeat(mask, width[f[0]])
        return [*(x[mask] for x in f[:5]), f[5][wide], f[6][wide]]

    item = np.flatnonzero(width > 0)
    t = terms[_ranges(ptr[item], width[item])]
    front = bounded(item, np.zeros(len(item), np.int64), np.full(len(item), lists.size), lists.start[t], lists.start[t + 1])
    while True:
        item, lo, _, bound = front[:4]
        front = picked(front, (bound > least[item]) | (bound == least[item]) & (lo < behind[item]))
        item, lo, hi, bound = front[:4]
        if not len(item):
            return got[0], got[1], got[2]
        order = np.lexsort((lo, -bound, item))
        place = np.empty(len(item), np.int64)
        place[order] = np.arange(len(item)) - np.searchsorted(item[order], item[order])
        now = place < WIDTH
        rest, (item, lo, hi, _, split, left, right) = picked(front, ~now), picked(front, now)
        own = np.repeat(np.arange(len(item)), width[item])
        t = terms[_ranges(ptr[item], width[item])]
        leaf = hi - lo <= LEAF
        found = [got[:3]]
        if leaf.any():  # every posting of these intervals
            some = np.flatnonzero(leaf[own] & (right > left))
            size = right[some] - left[some]
            at = _ranges(left[some], size)
            cell = np.repeat(own[some], size) * LEAF + lists.docs[at] - np.repeat(lo[own[some]], size)
            cells, to = np.unique(cell, return_inverse=True)
            score = np.zeros(len(cells), np.int64)
            np.add.at(score, to, lists.impact[at])
            found.append((item[cells // LEAF], score, lo[cells // LEAF] + cells % LEAF))
        if not leaf.all():
            f = picked([item, lo, hi, hi, split, left, right], ~leaf)
            item, lo, hi, _, split, left, right = f
            own = np.repeat(np.arange(len(item)), width[item])
            want = terms[_ranges(ptr[item], width[item])] * lists.size + split[own]
            at = np.searchsorted(lists.key, want)
            there = lists.key[np.minimum(at, len(lists.key) - 1)] == want
            score = np.zeros(len(item), np.int64)
            np.add.at(score, own[there], lists.impact[at[there]])
            found.append((item, score, split))
            new = bounded(np.concatenate([item, item]), np.concatenate([lo, split + 1]), np.concatenate([split, hi]), np.concatenate([left, at + there]), np.concatenate([at, right]))
            new = picked(new, new[3] > 0)
            rest = [np.concatenate(x) for x in zip(rest, new)]
        front = rest
        i, s, d = (np.concatenate(x) for x in zip(*found))
        good = (s > least[i]) | (s == least[i]) & (d < behind[i]) | (np.arange(len(i)) < len(got[0]))
        got = _kept(i[good], s[good], d[good], k)
        full = got[3] == k - 1
        least[got[0][full]], behind[got[0][full]] = got[1][full], got[2][full]


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) with a score above 0 for each row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    asked = items.select("item_id", F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("item_row"))
    texts = items.filter(F.col("text").isNotNull()).select("text").distinct().withColumn("key", F.xxhash64("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    schema, doc_id = "key long, doc_id long, score long", docs.schema["doc_id"].dataType.simpleString()
    parts, hits = -(-int(size) // ITEM_BYTES), spark.createDataFrame([], schema)
    for part in range(parts):
        t = texts.filter(F.pmod("key", F.lit(parts)) == part).toArrow()
        hits = hits.unionByName(_ranked(docs, read_items(t["key"].to_pylist(), t["text"]), k, schema))
    out = asked.join(hits, "key").withColumn("rank", F.row_number().over(Window.partitionBy("item_row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())))
    return out.select("item_id", "rank", F.col("doc_id").cast(doc_id).alias("doc_id"), "score")


def _ranked(docs: DataFrame, items: Items, k: int, schema: str) -> DataFrame:
    spark = docs.sparkSession
    if not len(items.hashes):
        return spark.createDataFrame([], schema)
    made = pack_blocks(docs, items).withColumn("pilot", F.pmod(F.xxhash64("ids"), F.lit(PILOT)) == 0)
    blocks = stored(made, by="pilot")
    total, length = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not total:
        return spark.createDataFrame([], schema)
    df = np.zeros(len(items.hashes), np.int64)
    for r in blocks.select(F.posexplode("df").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of this part of the items
        df[r["term"]] = r["n"]
    weight = np.floor(1000 * np.log((2.0 * total + 2) / (2.0 * df + 1))).astype(np.int64)
    weighty = weight * (df > 0)

    def searched(chosen: DataFrame, floor: np.ndarray) -> DataFrame:
        held = Shared(spark, (items, weighty, floor))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, w, least = held.value
            for b in batches:
                for ids, lengths, places, tfs, counts in zip(*(b.column(c) for c in ("ids", "lengths", "docs", "tf", "df"))):
                    ids, n = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(lengths.as_py(), np.int64)
                    doc, tf = np.frombuffer(places.as_py(), np.int32), np.frombuffer(tfs.as_py(), np.int32).astype(np.int64)
                    own = np.asarray(counts.values)
                    m = 50 + 50 * n * total // length
                    impact = np.repeat(w, own) * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                    lists = Lists(own, doc, impact, len(ids))
                    first = 0
                    while first < len(asked.keys) and len(doc):
                        last = max(first + 1, int(np.searchsorted(asked.ptr, asked.ptr[first] + SEARCH_TERMS)) - 1)
                        last = min(last, len(asked.keys))
                        at = asked.ptr[first:last + 1]
                        i, s, d = search_block(lists, at - at[0], asked.terms[at[0]:at[-1]], least[first:last], k)
                        yield pa.record_batch({"key": pa.array(np.array(asked.keys, np.int64)[first + i]), "doc_id": pa.array(ids[d], mask=ids[d] == NO_ID), "score": pa.array(s)})
                        first = last

        return chosen.select("ids", "lengths", "docs", "tf", "df").mapInArrow(search, schema)

    order = Window.partitionBy("key").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = lambda rows: rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    lowest = np.ones(len(items.keys), np.int64)
    pilot = stored(best(searched(blocks.filter("pilot"), lowest)))
    number = {key: i for i, key in enumerate(items.keys)}
    floor = lowest.copy()
    for r in pilot.filter(F.col("_r") == k).collect():  # a row for each item of this part at most
        floor[number[r["key"]]] = max(1, r["score"])
    return best(pilot.drop("_r").unionByName(searched(blocks.filter("not pilot"), floor))).drop("_r")
